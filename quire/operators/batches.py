"""Requests sent in batches and what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_results(pending: DataFrame, results: DataFrame, missing: Column, order: Column | None = None) -> DataFrame:
    """pending with ``body`` and ``outcome``: done, retry (the result is an error, body null) or missing (body is the sentinel).

    pending: custom_id and what else; results: (custom_id, text, error).  Of several results of one request the last by
    ``order`` counts, those without an error first."""
    rank = F.struct(F.col("error").isNull().alias("fine"), (F.lit(0) if order is None else order).alias("n"))
    last = results.groupBy("custom_id").agg(F.max_by(F.struct("text", "error"), rank).alias("r"))
    joined = pending.join(last, "custom_id", "left")
    outcome = F.when(F.col("r").isNull(), "missing").when(F.col("r.error").isNotNull(), "retry").otherwise("done")
    body = F.when(F.col("r").isNull(), missing).otherwise(F.col("r.text"))
    return joined.select(*pending.columns, body.alias("body"), outcome.alias("outcome"))


def retry_list(joined: DataFrame) -> DataFrame:
    """Requests to send again."""
    return joined.filter("outcome = 'retry'").drop("body", "outcome")


def completed(done: DataFrame, pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, pages): the set of finished pages with new ones added, sorted.  done: (key, pages)."""
    fresh = pages.groupBy(key).agg(F.collect_set(page).alias("new__"))
    both = done.join(fresh, key, "full_outer")
    none = F.array().cast(f"array<{dict(pages.dtypes)[page]}>")
    return both.select(key, F.array_sort(F.array_union(F.coalesce("pages", none), F.coalesce("new__", none))).alias("pages"))
