"""A Spark session with the settings that the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "plumeria", **settings: str) -> SparkSession:
    """The running session, or a new one; ``settings`` have underscores for dots."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    return builder.config(map={k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
