"""Similarities are those of whole readings, as the standard library gives them."""

import difflib
import random
import time

from pyspark.sql import functions as F

from quire.functions import udfs
from quire.plans import fixtures as fx
from quire.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def matched(a, b):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


def test_matched_characters():
    rng = random.Random(3)
    for n in range(400):
        letters = ["ab", "abcdefgh", "ab\n]^-\\ é"][n % 3]
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(2))
        assert udfs.matched_characters(a, b) == matched(a, b), (a, b)
    for n in range(60):  # long enough for popular characters
        letters = [chr(97 + i) for i in range((3, 40, 300)[n % 3])]
        a = "".join(rng.choices(letters, [1 / (i + 1) ** 2 for i in range(len(letters))], k=rng.randint(190, 1200)))
        b = list(a)
        for _ in range(len(b) // 10):
            b[rng.randrange(len(b))] = rng.choice(letters)
        b = "".join(b[:50] + b[80:] + b[10:60])
        assert udfs.matched_characters(a, b) == matched(a, b)


def test_lines_after_the_first_count(spark):
    rows = [("uno\ndos tres\n" * 30, "uno\n4os tr3s\n" * 30), ("uno\ndos", "uno\nxyz"), ("", ""), (None, "a"), ("a\nb", "a\nb")]
    got = spark.createDataFrame(rows, "a string, b string").select(udfs.sequence_ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in rows]


def test_queries_read_whole_texts(spark):
    pairs = [r for r in fx.pairs(spark, SF).collect() if r.a != r.b]
    expected = {r.doc_id: difflib.SequenceMatcher(None, r.a, r.b).ratio() for r in pairs}
    got = {r.doc_id: r.ratio for r in QUERIES["sequence_ratio"](spark, SF).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - x) < 1e-6 for i, x in expected.items())
    for r in QUERIES["run_similarity"](spark, SF).collect():
        own = sorted(difflib.SequenceMatcher(None, p.a.strip(), p.b.strip()).ratio() for p in pairs if p.source == r.source and p.a.strip() != p.b.strip())
        if not own:
            assert (r.mean_ratio, r.median_ratio, r.below_95, r.below_90) == (None, None, 0, 0)
            continue
        assert abs(r.mean_ratio - sum(own) / len(own)) < 1e-6 and abs(r.median_ratio - own[len(own) // 2]) < 1e-6
        assert (r.below_95, r.below_90) == (sum(x < 0.95 for x in own), sum(x < 0.9 for x in own))


def test_work_does_not_grow_with_places():
    """Texts whose every character seeds blocks: comparing all places at each block takes minutes."""
    rng = random.Random(4)
    letters = [chr(200 + i) for i in range(150)]
    a = rng.choices(letters, k=40_000)
    b = [rng.choice(letters) if rng.random() < 0.1 else x for x in a]
    began = time.process_time()
    assert udfs.matched_characters("".join(a), "".join(b)) > 34_000
    assert time.process_time() - began < 10


def test_long_runs_are_compared_by_places():
    rng = random.Random(6)
    a = "".join(rng.choices([chr(200 + i) for i in range(150)], k=1500))
    b = a[:700] + "xyz" + a[600:1400]
    assert udfs.matched_characters(a, b) == matched(a, b)
