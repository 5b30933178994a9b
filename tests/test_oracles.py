import pytest

from oracle import oracle_rows, rows_of
from quire.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, sf, name):
    columns, rows = rows_of(registry.QUERIES[name](spark, sf))
    expected = oracle_rows(registry.ORACLES[name], sf)
    assert rows, "a query must not match by being empty"
    assert (columns, rows) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
