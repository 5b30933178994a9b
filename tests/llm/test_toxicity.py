import math
import random
import re
import zlib

import pytest
import zstandard

import cases
from quire.llm import toxicity


def corpus(n):
    rnd = random.Random(1)
    plain = ["".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randrange(1, 4))) for _ in range(400)]
    bad = ["grumpf", "zwackel", "knurrig", "blarghy", "snorkel"]
    rows, labels = [], []
    for i in range(n):
        t = [rnd.choice(plain) for _ in range(rnd.randrange(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                t.insert(rnd.randrange(len(t)), rnd.choice(bad) + rnd.choice(["", ".", ",", "!"]))
        rows.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r for r in toxicity.score_toxicity(cases.documents(spark, rows), known).collect()}
    held = [(scored[i].score >= 0.3, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in labels)
    hits = sum(p for p, t in held if t) / sum(t for _, t in held)
    alarms = sum(p for p, t in held if not t) / sum(1 - t for _, t in held)
    assert hits >= 0.9 and alarms <= 0.05


def test_labels_of_the_test_fold_are_not_read(spark):
    rows, labels = corpus(300)
    wrong = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    docs = cases.documents(spark, rows)
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, wrong))
    assert a == b


def test_cases(spark):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (99, 0, 1), (2, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(cases.documents(spark), labels).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_toxicity(cases.documents(spark), none).collect()} == {0.0}
    assert toxicity.score_toxicity(cases.empty(spark), labels).count() == 0
    rows, labels = corpus(200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert len(toxicity.score_toxicity(cases.documents(spark, cases.ROWS), known).collect()) == len(cases.ROWS)


def test_rows_against_a_loop_over_documents(spark):
    """The same model, applied to one document and one window at a time."""
    rows, labels = corpus(400)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = cases.documents(spark, rows + cases.ROWS[:7])
    model = toxicity.fitted(docs.select("doc_id", "text"), known)
    ordinary, toxic = model["dictionaries"]
    parameters = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=6, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    end = b"\n" * 16 + bytes(range(1, 17))
    packers = []
    for content in (ordinary + end, ordinary + toxic + end):
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=parameters)
        packers.append(zstandard.ZstdCompressor(dict_data=own, compression_params=parameters))

    def score(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words, evidence = re.findall(r"[^\x20\x09-\x0D]+", lowered) or [""], []
        for n, step in ((1, 1), (3, 2)):
            windows = [words[i : i + n] for i in range(0, max(1, len(words) - n + step), step)]
            data = [b"\n" * 16 + f" {' '.join(w)} ".encode() + bytes(range(1, 17)) for w in windows]
            gains = [len(packers[0].compress(x)) - len(packers[1].compress(x)) for x in data]
            if n == 1:
                single = gains
            else:  # runs without a word that gains by itself have no gain
                gains = [g if any(x > 0 for x in single[i * step : i * step + n]) else 0 for i, g in enumerate(gains)]
            evidence.append(max(0, *gains))
            for least in (3, 4, 5, 6, 8):
                hits = sum(g >= least for g in gains)
                evidence += [math.log1p(hits), hits / len(gains)]
        total = model["weights"][-1] + sum(w * e / s for w, e, s in zip(model["weights"], evidence, model["scale"], strict=False))
        return 1 / (1 + math.exp(-max(-30, min(30, total))))

    expected = sorted((str(i), round(score(t), 9)) for i, t, *_ in rows + cases.ROWS[:7])
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score_toxicity(docs, known).collect()) == expected


def test_recall_of_each_language(spark):
    """Held-out rows of sf0.1.  Some toxic rows of en hold no toxic word at all."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [(lang[r.doc_id], truth[r.doc_id], r.predicted) for r in toxicity.op10_toxicity(spark, sf).filter("held_out").collect() if r.doc_id in truth]
    for name in ("en", "fr", "de", "es"):
        hits = [p for x, t, p in held if x == name and t]
        alarms = [p for x, t, p in held if x == name and not t]
        assert sum(hits) >= 0.9 * len(hits) and sum(alarms) <= 0.02 * len(alarms), (name, sum(hits), len(hits), sum(alarms), len(alarms))


def test_inflected_forms_gain():
    texts = [f"word{i} idiot and some idiotic words of idiots number {i * 7}" for i in range(40)]
    plain = [f"word{i} and some other words of people number {i * 7}" for i in range(80)]
    strings = toxicity.candidates(texts)
    a, b = (toxicity.document_counts(x, strings).sum(axis=0)[0] for x in (texts, plain))
    marked = strings[toxicity.over_represented(a, 40, b, 80)]
    gains = toxicity.Gains(*toxicity.dictionaries(texts, plain, marked, 4096, 1024))
    of = lambda w: int(gains.of([toxicity.window([w])])[0])
    assert of(b"idiot") >= 3 and of(b"idiots!") >= 3 and of(b"idiotically") >= 3 and of(b"people") <= 0


def test_strings_against_sets():
    text = "The  quick brown foxes\nare thé quickest"
    words = toxicity.words_of(text)
    expected = {}
    for i, w in enumerate(words):
        padded = b" " + w + b" "
        for k in toxicity.GRAMS:
            for a in range(len(padded) - k + 1):
                expected.setdefault(i, []).append(padded[a : a + k])
    hashes, places = toxicity.grams_of(words)
    assert sorted(places.tolist()) == sorted(i for i, own in expected.items() for _ in own)
    by_hash = {}
    for own in expected.values():
        for g in own:
            by_hash[g] = by_hash.get(g, 0) + 1
    assert len(set(hashes.tolist())) == len(by_hash)


def test_bounds_of_the_sample(spark):
    """Rows and bytes are bounded, repeated rows count once, and the constant makes up for what was left out."""
    rows, labels = corpus(400)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = cases.documents(spark, rows + rows).select("doc_id", "text")
    (whole, share), (toxic, _) = toxicity.sample(docs, known, (10_000, 10_000), 1 << 30)
    assert share == 1.0 and len(whole) == sum(1 for i, _, t in labels if not t and zlib.crc32(str(i).encode()) % 4 != 2)
    few, share = toxicity.sample(docs, known, (20, 10), 1 << 30)[0]
    assert few == whole[:20] and share == 20 / len(whole)
    small, _ = toxicity.sample(docs, known, (10_000, 10_000), 5000)[0]
    assert 0 < sum(len(t.encode()) for t in small) <= 5000
    a, b = toxicity.learn(toxic, whole[:100], (1.0, 1.0)), toxicity.learn(toxic, whole[:100], (1.0, 0.25))
    assert b["weights"][-1] - a["weights"][-1] == pytest.approx(math.log(0.25))
