"""Sessions: a user's events stay together as long as the gap doesn't exceed 1800 seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_S = 1800


def sessionize(events: DataFrame, user: str = "user_id", time: str = "s", gap: int = GAP_S) -> DataFrame:
    """``events`` with ``session`` (counted from 1 within the user) and ``session_start``."""
    w = Window.partitionBy(user).orderBy(time, "event_id")
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(user, "session")
    return numbered.withColumn("session_start", F.min(time).over(own)).drop("_new")
