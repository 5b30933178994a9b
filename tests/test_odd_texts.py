"""Queries over texts that the driver's small tables don't have, against their SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle import oracle_rows, rows_of
from quire.plans import registry

TEXTS = [
    None, "", " ", "\n", "\n\n", "  uno \n dos ", "uno\t\r\ndos\r\n", "quetzal uno  \ntlan ", " tepetl \n dos   ", "a\x0btl\x0b \x0b\nb\x0b",
    "uno --- FOOTNOTE --- dos\ntres --- END FOOTNOTE --- cuatro ", "---- \x01--- x\x01\n\x01 --- \x01\x01", "uno dos", "\U0001f600 tl\U0001f600\n\U0001f600 uno",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory, sf):
    d = tmp_path_factory.mktemp("odd")
    for name in ("region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations").split():
        (d / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    rows = pa.table({"doc_id": pa.array(range(1, len(TEXTS) + 1), pa.int64()), "text": TEXTS, "lang": ["es"] * len(TEXTS), "source": ["s"] * len(TEXTS), "n_chars": pa.array([len(t or "") for t in TEXTS], pa.int64())})
    pq.write_table(rows, d / "documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["footnote_segments", "language_placeholders"])
def test_equals_oracle_on_odd_texts(spark, odd, name):
    assert rows_of(registry.QUERIES[name](spark, odd)) == oracle_rows(registry.ORACLES[name], odd)
