"""Streams: rate limits as keyed state, job progress from appended JSON lines, credits in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..sources.files import PROGRESS


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress events as they are appended below path."""
    return spark.readStream.schema(PROGRESS).json(path)


def job_status(events: DataFrame, now: float, stale_s: float = 900.0) -> DataFrame:
    """Last event per job, whether it is stale, and the seconds left once two pages are done."""
    last = events.groupBy("job").agg(F.max_by(F.struct("ts", "event", "page", "done", "total"), "ts").alias("e"), F.min("ts").alias("began"))
    rate = F.try_divide(F.col("e.done"), F.col("e.ts") - F.col("began"))
    left = F.when(F.col("e.done") >= 2, F.try_divide(F.col("e.total") - F.col("e.done"), rate))
    return last.select("job", "e.*", (F.lit(now) - F.col("e.ts") > stale_s).alias("stale"), left.alias("seconds_left"))


def rate_limited(calls: DataFrame, window_s: int = fixed.RATE_WINDOW_S, limit: int = fixed.RATE_LIMIT) -> DataFrame:
    """calls: (licence, t, event_id) stream -> (licence, event_id, allowed).  The window begins with
    the first call after the last one ran out; refused calls count.  State: two numbers a licence."""

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        allowed = []
        for t in rows["t"]:
            if begin is None or t - begin >= window_s:
                begin, n = int(t), 0
            n += 1
            allowed.append(n <= limit)
        state.update((begin, n))
        yield pd.DataFrame({"licence": rows["licence"], "event_id": rows["event_id"], "allowed": allowed})

    return calls.groupBy("licence").applyInPandasWithState(decide, "licence long, event_id long, allowed boolean", "begin long, n long", "append", GroupStateTimeout.NoTimeout)


def commit_credits(attempts: DataFrame) -> DataFrame:
    """attempts: (licence, key, event_id, total, cost) stream -> (licence, event_id, outcome).  State:
    what is left and the committed keys of a licence."""

    def commit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("event_id")
        left, seen = state.get if state.exists else (int(rows["total"].iloc[0]), [])
        known, out = set(seen), []
        for k, cost in zip(rows["key"], rows["cost"], strict=True):
            if k in known:
                out.append("duplicate")
            elif left < cost:
                out.append("insufficient")
            else:
                left -= int(cost)
                known.add(k)
                out.append("committed")
        state.update((left, sorted(known)))
        yield pd.DataFrame({"licence": rows["licence"], "event_id": rows["event_id"], "outcome": out})

    return attempts.groupBy("licence").applyInPandasWithState(commit, "licence long, event_id long, outcome string", "left long, keys array<string>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events by type in tumbling or sliding windows of event time (a Spark built-in)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
