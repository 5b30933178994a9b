"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

1. quality: documents that the base rule or the fertility bands reject go.
2. lines: lines that an earlier document has go; a document that loses all its lines goes too.
3. near: one document of each group of near-duplicates (five-word shingles, 0.8) stays.
4. mix: whole copies of documents by the sources' targets, 0 to 3 of each.
5. tokens: every remaining text encoded and decoded; a row per row, with its ids.

Repeated rows are kept until stage 3 and may appear again in stage 4, whose repeats count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe_automaton import digest_texts
from quire.llm.common import BLANKS, Workspace, remove, stash, table
from quire.llm.fertility import measure_quality
from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import mix_documents
from quire.llm.near_dedup import near_representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    measured = measure_quality(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return measured.filter(F.col(measured.columns[-1])["kept"]).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where lines go, n_chars follows the text."""
    done = dedup_lines(docs)
    dropped = F.col(done.columns[-1])["dropped"]
    done = done.filter((dropped == 0) | (F.btrim("text", F.lit(BLANKS)) != ""))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(dropped > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_representatives(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Tokenization, fertility and sketches have no SQL; tests hold the rows of each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is removed when the next one is done."""
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark, "pipeline") as work:
        for i, (name, stage) in enumerate(STAGES):
            done = stage(spark, docs, sf_dir)
            docs = work.result(done) if i == len(STAGES) - 1 else stash(done, work.path(name))
            if i:
                remove(spark, work.path(STAGES[i - 1][0]))
    return docs
