"""Negative items for clicks, drawn by place so that no click meets the whole pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.scores import md5_number


def drawn(clicks: DataFrame, catalogue: DataFrame, draws: int, wanted: int, seed: str = "negative") -> DataFrame:
    """(event_id, k, item): up to ``wanted`` items for each click (event_id, user_id, s), out before it and never clicked.

    Items are numbered in order of publication; the number that are out at a click comes from an as-of count by day,
    and ``draws`` repeatable numbers up to it name the candidates.
    """
    day = F.expr("pub_s div 86400")
    items = catalogue.withColumn("day", day)
    sums = items.groupBy("day").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = sums.select("day", earlier.alias("base"))  # one row for each day that has items
    inside = F.row_number().over(Window.partitionBy("day").orderBy("pub_s", "item"))
    numbered = items.join(days, "day").select("item", "pub_s", (F.col("base") + inside).alias("place"))
    seconds = clicks.select("s").distinct()
    both = numbered.select(F.col("pub_s").alias("at"), F.lit(1).alias("kind"), "place").unionByName(seconds.select(F.col("s").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place")))
    both = both.withColumn("day", F.expr("at div 86400"))
    tops = both.groupBy("day").agg(F.max("place").alias("top"))
    tops = tops.select("day", F.coalesce(F.max("top").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("top"))
    so_far = F.max("place").over(Window.partitionBy("day").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("own", so_far).join(tops, "day").where("kind = 0").select(F.col("at").alias("s"), F.greatest("own", "top").alias("pool"))
    tries = clicks.join(out, "s").where("pool > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    tries = tries.select("event_id", "user_id", "j", (1 + md5_number(F.lit(seed), F.col("event_id"), F.col("j")) % F.col("pool")).alias("place"))
    fresh = tries.join(numbered.select("place", "item"), "place").join(clicks.select("user_id", "item").distinct(), ["user_id", "item"], "left_anti")
    once = fresh.groupBy("event_id", "item").agg(F.min("j").alias("j"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("j"))).where(F.col("k") <= wanted)
