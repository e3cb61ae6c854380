"""Sessions: settings that the operators count on, over whatever master is configured."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", **settings: str) -> SparkSession:
    """An active or new session: UTC, adaptive plans with skewed joins split. Partition counts are left to the
    cluster's settings and to adaptive coalescing."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
