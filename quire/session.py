"""Session defaults that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quire", **options: str) -> SparkSession:
    """A session in UTC with adaptive execution; options override (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in options.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
