import pytest

from oracle import oracle_rows, rows_of
from quire.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, sf, name):
    columns, rows = rows_of(registry.QUERIES[name](spark, sf))
    assert rows and (columns, rows) == oracle_rows(registry.ORACLES[name], sf)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
