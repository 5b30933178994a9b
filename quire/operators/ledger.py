"""Licences, credits and rate limits as ordered folds over a licence's own events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def activations(events: DataFrame, licence: str, order: str) -> DataFrame:
    """(licence, total_credits, email, activated, last_seen): the first activation sets the credits,
    later ones change the email only where they have one."""
    first = F.min_by(F.struct("credits", order), order)
    email = F.max_by("email", F.when(F.coalesce(F.col("email"), F.lit("")) != "", F.col(order)))
    return events.groupBy(licence).agg(first.alias("f"), F.coalesce(email, F.lit("")).alias("email"), F.max(order).alias("last_seen")).select(licence, F.col("f.credits").alias("total_credits"), "email", F.col(f"f.{order}").alias("activated"), "last_seen")


def commit_unit(attempts: DataFrame, licence: str, key: str, order: str, total: str) -> DataFrame:
    """Attempts of one credit each with ``outcome``: committed, duplicate or insufficient.

    With unit cost the first attempts of the first ``total`` keys are the committed ones, so two
    window functions do: no fold."""
    first = F.row_number().over(Window.partitionBy(licence, key).orderBy(order))
    seen = attempts.withColumn("__first", first == 1)
    rank = F.sum(F.col("__first").cast("int")).over(Window.partitionBy(licence).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    of_key = F.first("__rank").over(Window.partitionBy(licence, key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = seen.withColumn("__rank", rank).withColumn("__key", of_key)
    return ranked.withColumn("outcome", F.when(F.col("__key") > F.col(total), "insufficient").when(F.col("__first"), "committed").otherwise("duplicate")).drop("__first", "__rank", "__key")


def commit_variable(attempts: DataFrame, licence: str, key: str, order: str, total: str, cost: str) -> DataFrame:
    """(licence, committed, duplicates, insufficient, remaining) with costs of any size.

    A refused attempt leaves no trace, so a cumulative sum would be wrong: attempts of a licence are
    folded in order with the keys committed so far."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(cost).cast("long").alias("c"))))
    grouped = attempts.groupBy(licence).agg(ordered.alias("a"), F.max(total).cast("long").alias("t"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.col("t").alias("left"), F.array().cast("array<string>").alias("keys"), zero.alias("dup"), zero.alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        known, short = F.array_contains(acc["keys"], x["k"]), acc["left"] < x["c"]
        good = ~known & ~short
        return F.struct((acc["left"] - F.when(good, x["c"]).otherwise(0)).alias("left"), F.when(good, F.concat(acc["keys"], F.array(x["k"]))).otherwise(acc["keys"]).alias("keys"), (acc["dup"] + known.cast("int")).alias("dup"), (acc["bad"] + (~known & short).cast("int")).alias("bad"))

    done = grouped.select(licence, F.aggregate("a", start, step).alias("s"))
    return done.select(licence, F.size("s.keys").cast("long").alias("committed"), F.col("s.dup").alias("duplicates"), F.col("s.bad").alias("insufficient"), F.col("s.left").alias("remaining"))


def rate_limited(calls: DataFrame, licence: str, at: str, order: str, window: int = fixed.RATE_WINDOW_S, limit: int = fixed.RATE_LIMIT) -> DataFrame:
    """(licence, order, allowed) of every call.  A window begins with the first call after the last one
    ran out and counts refused calls too, so it is no tumbling window but a fold."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).cast("long").alias("t"), F.col(order).alias("o"))))
    start = F.struct(F.lit(None).cast("long").alias("begin"), F.lit(0).alias("n"), F.array().cast("array<struct<o:bigint,ok:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["begin"].isNull() | (x["t"] - acc["begin"] >= window)
        n = F.when(fresh, F.lit(1)).otherwise(acc["n"] + 1)
        return F.struct(F.when(fresh, x["t"]).otherwise(acc["begin"]).alias("begin"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("long").alias("o"), (n <= limit).alias("ok")))).alias("out"))

    done = calls.groupBy(licence).agg(ordered.alias("c")).select(licence, F.explode(F.aggregate("c", start, step)["out"]).alias("x"))
    return done.select(licence, F.col("x.o").alias(order), F.col("x.ok").alias("allowed"))
