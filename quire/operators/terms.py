"""Term dictionaries: merging, exclusion, counting in documents, tuning from patch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import match_view


def merge_keep_first(terms: DataFrame, term: str = "term", order: str = "ord", by: list[str] | None = None) -> DataFrame:
    """Case-insensitive union: the first spelling stands, in the order given."""
    w = Window.partitionBy(*(by or []), F.lower(term)).orderBy(order)
    return terms.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def without_soft(terms: DataFrame, soft: DataFrame, term: str = "term") -> DataFrame:
    """Terms that aren't soft, whatever their case."""
    return terms.withColumn("__k", F.lower(term)).join(soft.select(F.lower(term).alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def occurrences(view: Column, term: Column) -> Column:
    """Non-overlapping occurrences of the lower-case term in a match view."""
    return F.when(F.length(term) > 0, (F.length(view) - F.length(F.replace(view, term, F.lit("")))) / F.length(term)).otherwise(0).cast("long")


def document_counts(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, n) for a bounded list of terms: an array literal next to each document, no join."""
    counted = docs.withColumn("__v", match_view(F.col(text))).select(id_col, F.explode(F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.struct(t.alias("term"), occurrences(F.col("__v"), F.lower(t)).alias("n")))).alias("x"))
    return counted.select(id_col, "x.term", "x.n").filter("n > 0")


def corpus_counts(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """(term, n, documents) over all documents; terms that nowhere occur have no row."""
    return document_counts(docs.withColumn("__id", F.lit(0)), terms, "__id", text).groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


def frequent_enough(counts: DataFrame, terms: DataFrame, always: list[str], least: int = 2) -> DataFrame:
    """Terms found at least ``least`` times, and those always kept."""
    known = terms.join(counts.select("term", "n"), "term", "left")
    return known.filter((F.coalesce("n", F.lit(0)) >= least) | F.lower("term").isin(*[a.lower() for a in always]))


def tuning(log: DataFrame) -> DataFrame:
    """log: (term, applied boolean, reason) -> per lower-case term checked, applied, unchanged, review."""
    a, unchanged = F.col("applied"), F.lower(F.coalesce("reason", F.lit(""))) == "unchanged"
    return log.groupBy(F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("checked"), F.count_if(a).alias("applied"), F.count_if(~a & unchanged).alias("rejected_unchanged"), F.count_if(~a & ~unchanged).alias("rejected_review"))


def demotion(stats: DataFrame, soft: list[str], least: int = fixed.DEMOTE_CHECKS) -> DataFrame:
    """Terms checked often and never applied, not soft already."""
    return stats.filter((F.col("checked") >= least) & (F.col("applied") == 0) & ~F.col("term").isin(*[s.lower() for s in soft] or [""]))


def promotion(stats: DataFrame, soft: list[str], least: int = fixed.PROMOTE_ATTEMPTS) -> DataFrame:
    """Soft terms after a run: those there are, and terms tried often without success."""
    tried = stats.filter((F.col("checked") >= least) & (F.col("applied") == 0)).select("term")
    there = stats.sparkSession.createDataFrame([(s,) for s in soft], "term string")
    return tried.unionByName(there).distinct()
