"""Tables with list columns as rows, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inview_rows(behaviours: DataFrame, keys: list[str], inview: str = "inview", clicked: str = "clicked") -> DataFrame:
    """(keys, place, item, clicked) for every item of the lists; a null or empty list has no rows."""
    rows = behaviours.select(*keys, F.posexplode(inview).alias("place", "item"), F.col(clicked).alias("_clicked"))
    hit = F.coalesce(F.array_contains("_clicked", F.col("item")), F.lit(False)).cast("int")
    return rows.select(*keys, F.col("place").cast("long").alias("place"), "item", hit.alias("clicked"))


def history_rows(history: DataFrame, keys: list[str], items: str = "items", times: str = "times") -> DataFrame:
    """(keys, item, time) for two list columns of one length."""
    zipped = F.arrays_zip(F.col(items).alias("item"), F.col(times).alias("time"))
    return history.select(*keys, F.inline(zipped))


def request_and_impressions(slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log's two tables of one write: a row for each request with its list, and a row for each shown place."""
    places = F.array_sort(F.collect_list(F.struct("position", "item")))
    requests = slots.groupBy("request").agg(
        F.min("user_id").alias("user_id"), F.count("*").alias("places"), F.count_if("explored").alias("explored"), F.transform(places, lambda x: x["item"]).alias("items")
    )
    return requests, slots.select("request", "position", "item", "explored", "propensity", "reward")
