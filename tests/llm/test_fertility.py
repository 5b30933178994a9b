import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from quire.llm import fertility

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def brute_repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40))
def test_repeated_words(words):
    assert fertility.repeated_words(words) == brute_repeated(words)


def test_lines_and_symbols():
    assert fertility.duplicate_lines("a\n\n\na\n \n \na b\nA") == 1
    assert sum(map("#a*$%&|<>##".count, fertility.SYMBOLS)) == 10


def test_tokens_of_words():
    text = "Thé quick  brown 日本 🙂 fox's x" + "y" * 30
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    words = text.split()
    ids = fertility.WordTokens(VOCABULARY).of([words])[0]
    assert ids.tolist() == [i for w in words for i in model.encode(w)]


def test_entropy():
    assert fertility.token_entropy(np.zeros(0, np.uint32), 10) == 0.0
    assert abs(fertility.token_entropy(np.arange(8).astype(np.uint32).repeat(10000), 10) - 3) < 1e-3


def brute(text):
    """The base figures of one text, by their definitions."""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    repeated = brute_repeated(words)
    duplicates = sum(any(w not in " \t\r\x0b\x0c" for w in line) and line in lines[:i] for i, line in enumerate(lines)) if len(lines) < 3000 else None
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, repeated, len(words) < 50 or 100 * repeated > 50 * len(words)


def brute_kept(text, lang, failed):
    """The verdict of the bands, with the whole words encoded one by one and counts in a dictionary."""
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    tokens = [i for w in re.findall(r"[^\x20\x09-\x0D]+", text) for i in model.encode(w)]
    n, chars = len(tokens), sum(len(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text))
    if failed or n < 50:
        return not failed
    counts = Counter(tokens).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts) + (len(counts) - 1) / (2 * n * math.log(2))
    least, most, share, floor, slack, entropy_slack = fertility.BANDS.get(lang) or fertility.BANDS[fertility.script_of(text)]
    unread = sum(model.is_byte(i) or model.is_unknown(i) for i in tokens)
    return least - slack / math.sqrt(n) <= chars / n <= most and unread <= share * n and entropy >= floor - entropy_slack / math.sqrt(n)


def test_cases(spark):
    docs = cases.documents(spark)
    measured = fertility.measure_quality(docs, VOCABULARY)
    assert measured.columns == [*docs.columns, "quality_"]
    rows = measured.collect()
    assert sorted(str(r[:-1]) for r in rows) == sorted(str(tuple(r)) for r in docs.collect())
    for r in rows:
        q, text = r.quality_, r.text or ""
        *base, failed = brute(text)
        assert [q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words] == base and q.base_failed == failed
        assert q.kept == brute_kept(text, r.lang, failed)
    assert fertility.measure_quality(cases.empty(spark), VOCABULARY, ["doc_id"]).count() == 0


def test_table_rows(spark, sf):
    """The query's figures on whole table rows, all columns, against the definitions."""
    texts = {r.doc_id: (r.text or "", r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = fertility.op3_fertility(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, lang = texts[r.doc_id]
        *base, failed = brute(text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == base and r.base_failed == failed
        assert r.kept == brute_kept(text, lang, failed)


def test_junk_goes_and_prose_stays(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in fertility.op3_fertility(spark, sf).collect() if r.doc_id in quality and not r.base_failed]
    good, bad = ([r.kept for r in rows if quality[r.doc_id] == q] for q in (1, 0))
    assert all(good) and sum(bad) < 0.5 * len(bad)


def test_bands_of_each_language(spark):
    """On labels that didn't set the bands (odd doc_id)."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("doc_id % 2 = 1").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id")
    measured = fertility.measure_quality(docs.withColumnRenamed("quality", "label"), VOCABULARY, ["doc_id", "lang", "label"])
    rows = [r for r in measured.select("lang", "label", "quality.*").collect() if not r.base_failed]
    for lang in ("en", "fr", "de", "es"):
        good, bad = ([r.kept for r in rows if r.lang == lang and r.label == q] for q in (1, 0))
        assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.15 * len(bad), (lang, len(good), sum(good), len(bad), sum(bad))


def test_each_measure_rejects():
    least, _, share, entropy, _, _ = band = fertility.BANDS["es"]
    n = 10_000
    assert fertility.in_band(band, int((least + 0.05) * n), n, 0, entropy, 50)
    assert not fertility.in_band(band, int((least - 0.05) * n), n, 0, entropy, 50)
    assert not fertility.in_band(band, int((least + 0.05) * n), n, int((share + 0.01) * n), entropy, 50)
    assert not fertility.in_band(band, int((least + 0.05) * n), n, 0, entropy - 0.2, 50)
