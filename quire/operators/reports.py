"""Reports over runs and jobs: disagreement, checks before a full run, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_skip, strip
from .profiles import script_direction
from .reconcile import difference


def disagreement(pages: DataFrame, keys: list[str], a: str, b: str, ratio: Column | None = None) -> DataFrame:
    """Per key: pages that both skip, agree, disagree; the share; with a ratio its mean, upper median and
    how many fall below 0.95 and 0.90."""
    x, y = F.col(a), F.col(b)
    skip = is_skip(x) & is_skip(y)
    differ = ~skip & (strip(x) != strip(y))
    judged = pages.select(*keys, skip.alias("skip"), differ.alias("differ"), *([F.when(differ, ratio).alias("r")] if ratio is not None else []))
    n = F.count(F.lit(1))
    out = [F.count_if("skip").alias("skipped"), F.count_if(~F.col("skip") & ~F.col("differ")).alias("agree"), F.count_if("differ").alias("disagree"), F.round(F.try_divide(F.count_if("differ") * 100.0, n - F.count_if("skip")), 2).alias("percent")]
    if ratio is not None:
        sorted_ = F.array_sort(F.collect_list("r"))
        out += [F.round(F.avg("r"), 6).alias("mean_ratio"), F.round(F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int")), 6).alias("median_ratio"), F.count_if(F.col("r") < 0.95).alias("below_95"), F.count_if(F.col("r") < 0.90).alias("below_90")]
    return judged.groupBy(*keys).agg(*out)


def categories(pages: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return pages.select(*keys, difference(F.col(a), F.col(b)).alias("category")).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))


def pilot_checks(jobs: DataFrame, pilot: int = 10) -> DataFrame:
    """jobs: (job, collisions, script, direction, source_name, source_id, impossible, rejected, blocked,
    review_pages, header_sources, pages_run, pages_before) -> a row per check and job, and whether the
    whole book is unlocked: by pages alone, red checks are advice."""
    c = F.col
    checks = {
        "no_batch_collisions": c("collisions") == 0,
        "direction": script_direction(c("script"), c("direction")) == c("direction"),
        "source_matches": (c("source_name") == "") | (c("source_id") == "") | (c("source_name") == c("source_id")),
        "impossible_strings": c("impossible") <= 200,
        "blocked_corrections": (c("rejected") == 0) | (F.try_divide("blocked", "rejected") <= 0.5),
        "no_human_review": c("review_pages") == 0,
        "headers_match": c("header_sources") <= 1,
    }
    all_ok = F.lit(True)
    for ok in checks.values():
        all_ok = all_ok & ok
    rows = jobs.select("job", all_ok.alias("all_passed"), (F.greatest("pages_run", "pages_before") >= pilot).alias("unlocked"), F.explode(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("passed")) for n, ok in checks.items()])).alias("x"))
    return rows.select("job", "x.check", "x.passed", "all_passed", "unlocked")


def human_review(causes: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct pages that some cause sends to review."""
    out = causes[0].select(*keys)
    for more in causes[1:]:
        out = out.unionByName(more.select(*keys))
    return out.distinct()
