from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import cases
from quire.llm import mixing


def by_quotients(votes, seats):
    """Seats one by one to the highest quotient."""
    out = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max((p for p in votes if votes[p] > 0), key=lambda p: (Fraction(votes[p], 2 * out[p] + 1), -p))
        out[best] += 1
    return out


def poured(words, weights, most=3):
    """Targets by sharing again and again."""
    total, full, target = sum(words), set(), [0.0] * len(words)
    while True:
        rest = total - sum(most * words[i] for i in full)
        w = sum(weights[i] for i in range(len(words)) if i not in full)
        target = [most * words[i] if i in full else rest * weights[i] / w for i in range(len(words))]
        over = {i for i in range(len(words)) if i not in full and target[i] > most * words[i] + 1e-9}
        if not over:
            return target
        full |= over


def test_sainte_lague(spark):
    votes = {0: 53, 1: 24, 2: 23, 3: 0, 4: 1, 5: 24}
    df = spark.createDataFrame([(0, p, v) for p, v in votes.items()], "g int, p int, v long")
    for seats in (0, 1, 2, 3, 7, 10, 101, 1000):
        got = {r.p: r.seats for r in mixing.sainte_lague(df, ["g"], ["p"], "v", F.lit(seats)).collect()}
        assert got == by_quotients(votes, seats), seats


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=9))
def test_targets(spark, sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    df = spark.createDataFrame([(f"s{i}", w, n) for i, (w, n) in enumerate(zip(weights, sizes, strict=True))], "source string, weight long, words long")
    got = [r.target for r in mixing.water_filled_targets(df).orderBy("source").collect()]
    expected = poured(sizes, weights) if sum(sizes) else [0.0] * len(sizes)
    assert all(abs(a - b) < 1e-6 * max(1, b) for a, b in zip(got, expected, strict=True))


def test_cases(spark):
    docs = cases.documents(spark)
    rows = mixing.mix_quotas(docs, block_words=8).collect()
    assert len(rows) == len(cases.ROWS)
    assert all(0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3 for r in rows)
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert set(target) == {"a", "b", "c", None}
    assert all(abs(taken[s] - t) <= 16 + 0.002 * t for s, t in target.items()), (taken, target)
    again = mixing.mix_quotas(docs.repartition(3), block_words=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix_quotas(cases.empty(spark)).count() == 0
    mixed = mixing.mix_documents(docs, block_words=8)
    assert mixed.columns == docs.columns
    copies, expected = Counter(map(str, mixed.collect())), Counter()
    by_key = {str(r.row): (r.k1, r.k2) for r in docs.select(mixing.whole()).withColumn("key", mixing.row_key(docs)).select("row", "key.k1", "key.k2").collect()}
    shares = Counter()
    for r in rows:
        shares[r.k1, r.k2] += r.copies
    for row, key in by_key.items():
        expected[row] = shares[key]
    assert copies == +expected and sum(expected.values()) == sum(r.copies for r in rows)


def test_rows_that_differ_in_one_column(spark):
    docs = cases.documents(spark, [(1, cases.words(500), "en", "a", 1), (1, cases.words(500), "fr", "a", 1)])
    assert sorted(r.lang for r in mixing.mix_documents(docs).collect()) == ["en", "fr"]


@pytest.mark.parametrize("sizes", [[850], [3] * 400, [1, 1, 1], [70] * 40, [40000, 3, 9, 0]])
def test_all_seats_are_dealt(spark, sizes):
    """One source must get all its words once, whatever the sizes of shards and blocks."""
    docs = cases.documents(spark, [(i, cases.words(n, i), "en", "a", 1) for i, n in enumerate(sizes)])
    for block_words, shard_words in ((8, 512), (64, 32768)):
        taken = sum(r.taken for r in mixing.mix_quotas(docs, block_words=block_words, shard_words=shard_words).collect())
        assert abs(taken - sum(sizes)) <= block_words + 0.01 * sum(sizes), (shard_words, taken)


def test_three_passes_are_the_most(spark):
    """A small source with a large weight is taken three times whole, without a lost seat."""
    rows = [(i, cases.words(90, i), "en", "b", 1) for i in range(30)] + [(100 + i, cases.words(900, i), "en", "a", 1) for i in range(40)]
    got = mixing.mix_quotas(cases.documents(spark, rows), block_words=8, shard_words=512).collect()
    assert {r.taken for r in got if r.source == "b"} == {270}
    taken = sum(r.taken for r in got if r.source == "a")
    assert abs(taken - (40 * 900 - 2 * 30 * 90)) <= 0.01 * 36000


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 40)), min_size=1, max_size=7), st.integers(0, 150))
def test_capped_seats(spark, parties, seats):
    df = spark.createDataFrame([(0, i, v, c if v else 0) for i, (v, c) in enumerate(parties)], "g int, p int, v long, most long")
    with mixing.Workspace(spark, "test") as work:
        got = {r.p: r.seats for r in mixing.capped_seats(df, "g", "p", "v", F.lit(seats), "most", work).collect()}
    caps = {i: c if v else 0 for i, (v, c) in enumerate(parties)}
    assert all(0 <= got[i] <= c for i, c in caps.items())
    assert sum(got.values()) == min(seats if any(v for v, _ in parties) else 0, sum(caps.values()))


def test_query_follows_targets(spark, sf):
    rows = mixing.op1_mixing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, target, size = defaultdict(int), {}, {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    names = sorted(size)
    expected = poured([size[n] for n in names], [i % 3 + 1 for i in range(len(names))])
    assert all(abs(target[n] - t) < 1e-6 * t for n, t in zip(names, expected, strict=True))
    assert all(abs(taken[n] - target[n]) < 0.005 * target[n] for n in names), (taken, target)
