"""Each stage's rows and texts against brute force; the chain of stages against run()."""

import hashlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import cases
import corpus_pipeline
from quire.llm import mixing
from quire.llm.common import new_folder, stash
from test_fertility import brute as quality_brute
from test_fertility import brute_kept
from test_line_dedup import brute as line_brute
from test_near_dedup import roots as near_roots

BLANKS = " \t\n\x0b\x0c\r"


def by_quality(rows):
    """Rows that neither the base rule nor the bands reject."""
    return Counter(str(r) for r in rows if brute_kept(r["text"] or "", r["lang"], quality_brute(r["text"] or "")[-1]))


def by_lines(rows):
    """Rows with the lines that stay, n_chars with them; emptied rows go."""
    out = Counter()
    for r, (_, _, dropped, _, text) in zip(rows, line_brute([(r["doc_id"], r["text"]) for r in rows], texts=True), strict=True):
        if not dropped:
            out[str(r | {"text": r["text"] or ""})] += 1
        elif text.strip(BLANKS):
            out[str(r | {"text": text, "n_chars": len(text)})] += 1
    return out


def by_groups(rows):
    """How many rows stay: one of each group; a row without words is a group of its own."""
    return len({r for _, r in near_roots([(r["doc_id"], r["text"]) for r in rows], 5)})


def checked(spark, docs, sf):
    """The last stage's rows, after each stage has been compared with brute force."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, columns = stash(docs, new_folder(spark, "start")), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [r.asDict() for r in before.collect()]
        after = stash(stage(spark, before, sf), new_folder(spark, name))
        got = [r.asDict() for r in after.collect()]
        seen = Counter(map(str, got))
        if name != "tokens":
            assert after.columns == columns
        if name == "quality":
            assert seen == by_quality(rows)
        if name == "lines":
            assert seen == by_lines(rows)
        if name == "near":
            assert not seen - Counter(map(str, rows)) and len(got) == by_groups(rows) == by_groups(got)
        if name == "mix":
            keyed = before.select(mixing.whole()).withColumn("key", mixing.row_key(before)).select("row", "key.k1", "key.k2")
            shares = mixing.mix_quotas(before).groupBy("k1", "k2").agg(F.sum("copies").alias("n"))
            expected = Counter()
            for r in keyed.dropDuplicates(["k1", "k2"]).join(shares, ["k1", "k2"]).collect():
                expected[str(r.row.asDict())] = r.n
            assert seen == +expected
        if name == "tokens":
            pairs = lambda d, ids: (str(d), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
            assert Counter((str(r["doc_id"]), r["ids_sha256"]) for r in got) == Counter(pairs(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
        before = after
    return Counter(map(str, before.collect()))


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert checked(spark, docs, sf) == Counter(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_hard_documents(spark, sf):
    """Null ids, clashing columns, repeated rows, rows that differ in one column, and an empty table."""
    prose = [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.n_chars > 500][:40]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in prose]
    rows += [(None, *r[1:]) for r in rows[:6]] + rows[6:12] + [(*r[:3], "elsewhere", r[4]) for r in rows[12:18]] + [(r[0], r[1], None, None, None) for r in rows[18:24]]
    docs = cases.documents(spark, cases.ROWS + rows)
    assert sum(checked(spark, docs, sf).values()) > 0
    assert sum(checked(spark, docs.limit(0), sf).values()) == 0


def test_rows_of_blanks_go(spark, sf):
    """A document that keeps only white space beside its lost lines goes, whatever the white space."""
    rows = [(1, "a line that is shared", "en", "s", 1), (2, "a line that is shared\n\t\n \x0b\r", "en", "s", 1), (3, "\n\t", "en", "s", 1)]
    assert [r.doc_id for r in corpus_pipeline.lines(spark, cases.documents(spark, rows), sf).orderBy("doc_id").collect()] == [1, 3]


def test_long_and_mixed_prose_stays(spark):
    """Clean texts of 20,000 words, also of two languages by turns, pass the quality stage; the longest junk of the table doesn't."""
    sf, n = "/root/testdata/sf0.1", 20_000
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id").orderBy("doc_id").collect()
    texts = lambda lang, label: list(dict.fromkeys(d.text for d in docs if d.lang == lang and d.quality == label))
    langs, rows = ("en", "fr", "de", "es"), []
    for lang in langs:
        words = " ".join(texts(lang, 1)).split()
        rows += [(f"{lang} {i}", " ".join(words[i : i + n]), lang) for i in range(0, min(len(words) - n, 5 * n), n)]
        rows += [(f"{lang} junk {i}", t, lang) for i, t in enumerate(sorted(texts(lang, 0), key=len)[-3:])]
    for other in ("fr", "es"):
        pairs = zip(texts("de", 1), texts(other, 1), strict=False)
        rows.append((f"de and {other}", " ".join(" ".join(t for p in pairs for t in p).split()[:n]), "de"))
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id string, text string, lang string"), sf).collect()}
    assert kept == {name for name, _, _ in rows if "junk" not in name}
