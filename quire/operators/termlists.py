"""Which term lists a job uses: ranked sources of hard terms, soft terms, lists made after the first reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .terms import frequent_enough, merge_keep_first


def file_matches_slug(path: Column, slug: Column) -> Column:
    """The slug is in the file's name, whatever the case; false for an empty one."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    return F.coalesce((slug != "") & name.contains(F.lower(slug)), F.lit(False))


def sources_in(paths: Column, pattern: str, default: str) -> Column:
    """Sorted source ids from file names (group 1 of pattern); the default alone where no name fits."""
    ids = F.array_distinct(F.filter(F.transform(paths, lambda p: F.regexp_extract(F.element_at(F.split(p, r"[/\\]"), -1), pattern, 1)), lambda x: x != ""))
    return F.when(F.size(ids) > 0, F.array_sort(ids)).otherwise(F.array(F.lit(default)))


def first_list(candidates: DataFrame, job: str, rank: str = "rank", terms: str = "terms") -> DataFrame:
    """(job, terms): of a job's lists the one of least rank that isn't empty; an empty list where all are.

    Ranks: 0 the job's own terms, 1 its file if that names the source, 2 the old common list of jobs without a
    source, 3 the source's made list, 4 its kept list, 5 the old common list of the default source."""
    best = F.min_by(terms, F.when(F.size(terms) > 0, F.col(rank)))
    return candidates.groupBy(job).agg(F.coalesce(best, F.array().cast("array<string>")).alias("terms"))


def soft_terms(lists: DataFrame, job: str, term: str = "term") -> DataFrame:
    """(job, term): lower-case union of the defaults, the job's own and the file's."""
    return lists.filter((F.col(term) != "") & F.col(term).isNotNull()).select(job, F.lower(term).alias("term")).distinct()


def hard_after_first_reading(seeds: DataFrame, extracted: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """(term, ord): seeds, then extracted terms that the reading has ``least`` times or that are seeds, each spelling once.

    seeds, extracted: (term, ord); counts: (term, n)."""
    known = seeds.select(F.lower("term").alias("k")).distinct()
    often = counts.filter(F.col("n") >= least).select(F.lower("term").alias("k")).distinct()
    kept = extracted.withColumn("k", F.lower("term")).join(known.unionByName(often).distinct(), "k", "left_semi").select("term", "ord")
    both = seeds.select("term", "ord", F.lit(0).alias("part")).unionByName(kept.withColumn("part", F.lit(1)))
    first = merge_keep_first(both.withColumn("place", F.struct("part", "ord")), order="place")
    return first.select("term", F.row_number().over(Window.orderBy("place")).alias("ord"))  # a term list's length


def impossible_after_first_reading(generated: DataFrame, hard: DataFrame, common: DataFrame, extra: DataFrame) -> DataFrame:
    """(term, ord): generated corruptions that are neither hard terms nor common words, then extras, each once."""
    away = hard.select(F.lower("term").alias("k")).unionByName(common.select(F.lower("term").alias("k"))).distinct()
    kept = generated.withColumn("k", F.lower("term")).join(away, "k", "left_anti").select("term", "ord", F.lit(0).alias("part"))
    both = kept.unionByName(extra.select("term", "ord", F.lit(1).alias("part"))).filter("term <> ''")
    first = merge_keep_first(both.withColumn("place", F.struct("part", "ord")), order="place")
    return first.select("term", F.row_number().over(Window.orderBy("place")).alias("ord"))  # a term list's length


def new_promotions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Terms that a run has added to the soft ones."""
    return after.select("term").distinct().join(before.select("term").distinct(), "term", "left_anti")


__all__ = ["file_matches_slug", "first_list", "frequent_enough", "hard_after_first_reading", "impossible_after_first_reading", "new_promotions", "soft_terms", "sources_in"]
