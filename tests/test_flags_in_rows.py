"""Flags of pages are folds within the row: no shuffle, and the same as those of a table of tokens."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import consensus
from quire.plans import fixtures as fx
from quire.plans.registry import QUERIES

RUNS = ["A", "B", "C"]


@pytest.mark.parametrize("name", ["flag_report", "consensus_flags", "review_queue", "review_lists", "page_documents"])
def test_nothing_is_shuffled(spark, sf, name):
    assert "Exchange" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "bb", "quetzal", "ññññññ", "seventeen letters"[: rng.randint(1, 15)].replace(" ", "x")])
    text = lambda n: "".join(word() + rng.choice([" "] * 9 + ["  ", "\n", "\t", "\r\n", "\xa0"] if n < 300 else " ") for _ in range(n))
    rows = [(i, *[text(n) if rng.random() < 0.5 else "uno seven77 dos " * (n // 3) for _ in RUNS]) for i, n in enumerate([0, 1, 5, 40, 255, 256, 257, 600, 1100])]
    rows += [(20, None, None, None), (21, "a b", None, "a"), (22, "", "x\n\ny", " "), (23, "a\n", "a", "a\n\n"), (24, "a b\x0bc\x1cd", "a b", None)]
    return spark.createDataFrame(rows, "page int, A string, B string, C string")


def test_flags_of_pages_are_those_of_tokens(spark, pages):
    tokens = consensus.judged(consensus.aligned_tokens(pages, RUNS), RUNS, fx.confidence)
    want = consensus.flags(tokens, ["page"], RUNS, F.col("page")).collect()
    got = consensus.flags_of_pages(pages, ["page"], RUNS, fx.confidence, extra=F.col("page")).collect()
    assert len(got) > 1000 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_confidences_are_looked_up_in_the_line(spark, pages):
    """Of equal texts the last counts, words that aren't there count 0, in short lines and in those with buckets."""
    lost = lambda tokens, line, run: (tokens, F.transform(tokens, lambda t, x: (x + F.when(F.lit(run) == "B", 1000).otherwise(0)).cast("double")))
    for r in consensus.flags_of_pages(pages, ["page"], RUNS, words=lost, threshold=1e9).groupBy("page", "line_index").agg(F.collect_list(F.struct("word_index", *RUNS, *[f"{x}_conf" for x in RUNS])).alias("w")).collect():
        for run in RUNS:
            last = {w[run]: w.word_index + (1000.0 if run == "B" else 0.0) for w in sorted(r.w, key=lambda w: w.word_index)} | {"": 0.0}
            assert all(w[f"{run}_conf"] == last[w[run]] for w in r.w)
    none = consensus.flags_of_pages(pages, ["page"], RUNS, words=lambda tokens, line, run: (F.array(F.lit("~")), F.array(F.lit(99.0))))
    assert none.agg(F.max("A_conf"), F.max("B_conf"), F.max("C_conf")).first() == (0.0, 0.0, 0.0)
