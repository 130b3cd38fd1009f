"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gradeloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Sizes are left to the cluster; pass others as keyword arguments with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
