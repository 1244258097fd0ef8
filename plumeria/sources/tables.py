"""The tables by name, and the event log, catalogue and article views that the queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items come out every seven hours from this second on (2024-01-01).
FIRST_PUBLISHED, PUBLISHED_EVERY = 1_704_067_200, 7 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone that holds UTC, by integers only."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS TIMESTAMP_NTZ))")


def instant(second: int) -> Column:
    """A second as a literal of the raw column's type, so a filter on it reaches the files."""
    return F.expr(f"timestampadd(SECOND, {second}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def event_log(spark: SparkSession, sf_dir: str, *kinds: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """(event_id, user_id, event_type, value, item, us, s) of the events of these types, or of all, of since <= s < until."""
    events = table(spark, sf_dir, "events")
    if since is not None:
        events = events.where(F.col("ts") >= instant(since))
    if until is not None:
        events = events.where(F.col("ts") < instant(until))
    if kinds:
        events = events.where(F.col("event_type").isin(*kinds))
    item = F.get_json_object("props", "$.k").cast("long")
    log = events.select("event_id", "user_id", "event_type", "value", item.alias("item"), micros("ts").alias("us"))
    return log.withColumn("s", F.expr("us div 1000000"))


def clicks(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    return event_log(spark, sf_dir, "click", since=since, until=until).drop("event_type", "value")


def views(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    return event_log(spark, sf_dir, "view", since=since, until=until).drop("event_type", "value")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req, user_id, t): every purchase is a request in the second after it."""
    return event_log(spark, sf_dir, "purchase").select(F.col("event_id").alias("req"), "user_id", (F.col("s") + 1).alias("t"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, emb, category, pub_s): categories count from 1, as 0 is none."""
    pub = F.lit(FIRST_PUBLISHED) + F.col("vec_id") * PUBLISHED_EVERY
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item"), F.col("embedding").alias("emb"), (F.col("label") + 1).alias("category"), pub.alias("pub_s")
    )
