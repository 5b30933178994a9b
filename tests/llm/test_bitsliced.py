import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bitsliced

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute(rows, k):
    """Every row is a candidate of its own, also where ids or whole rows repeat."""
    kept = []
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        most = math.isqrt((1 << 62) // len(v))
        kept.append((i, [max(-most, min(most, int(np.floor(64 * float(np.float32(x)))))) for x in v]))
    out = []
    for a, (i, v) in enumerate(kept):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(kept) if a != b and len(w) == len(v))
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s[:k], 1)]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in bitsliced.top_k(df, **options).collect())


def test_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(130)]
    rows += [(200 + i, [0.5] * 5) for i in range(60)]  # ties
    rows += [(300, None), (301, []), (302, [None] * 5), (303, [float("nan")] * 5), (304, [float("inf")] * 5), (320, [1.0, 2.0]), (305, [0.25, 1.0]), (None, [1.0] * 5)]
    rows += [(0, [3.0] * 5), (0, [3.0] * 5), (40, [0.5, -1.0, 2.0, 0.0, 1.0])]  # repeated rows, one id with several vectors
    for run in (1, 3, 8):
        assert got(spark, rows, k=20, block_rows=50, group_rows=3, block_run=run) == brute(rows, 20)
    assert got(spark, rows) == brute(rows, 20)
    assert got(spark, rows[:3], k=20) == brute(rows[:3], 20)
    assert got(spark, []) == []


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [3.0, 3.0])]
    assert got(spark, rows) == [(0, 1, 1, 36864), (0, 2, 1, 16384)] == brute(rows, 20)


def test_extreme_values(spark):
    """Components beyond the bound count as the bound; none fails."""
    rows = [(i, [s * x, 1.0, -x]) for i, (s, x) in enumerate([(1, 1e30), (-1, 1e30), (1, 3e38), (1, 1e12), (-1, 1e5), (1, 0.0)])] + [(20, [1e30, -1e30, 5.0]), (40, [7.0, 8.0, 9.0])]
    assert got(spark, rows) == brute(rows, 20)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-70, 70), min_size=3, max_size=3), min_size=1, max_size=150), st.lists(st.integers(-70, 70), min_size=3, max_size=3), st.integers(1, 25))
def test_slices(values, query, k):
    v = np.array(values, np.int64)
    rows, scores = bitsliced.Slices(v).best(query, k, None)
    exact = v @ np.array(query)
    order = np.lexsort((np.arange(len(v)), -exact))[:k]
    assert sorted(rows.tolist()) == sorted(order.tolist()) and (exact[rows] == scores).all()
