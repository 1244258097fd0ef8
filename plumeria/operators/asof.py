"""Point-in-time lookups: everything is strictly before the request, windows are half-open.

Bounded windows are joins on the key and a time bin, so no key meets all its events at once. Lookups over the whole
past run over the events and requests of a key in order, by prefix sums in two steps: over (key, time bucket), then
inside a bucket. A hot key is thus dealt over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_join(
    requests: DataFrame, events: DataFrame, key: str, low: str, high: str, time: str, width: int, how: str = "inner"
) -> DataFrame:
    """Requests with their key's events of ``low <= time < high``; ``width`` is the size of a time bin.

    The events' columns other than ``key`` must have names of their own.
    """
    bins = F.sequence(F.expr(f"{low} div {width}"), F.expr(f"greatest({low}, {high} - 1) div {width}"))
    spread = requests.withColumn("_bin", F.explode(bins))
    dealt = events.withColumnRenamed(key, "_key").withColumn("_at", F.expr(f"{time} div {width}"))
    match = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_at")) & (F.col(time) >= F.col(low)) & (F.col(time) < F.col(high))
    joined = spread.join(dealt, match).drop("_bin", "_key", "_at")
    if how == "inner":
        return joined
    return requests.join(joined.drop(*[c for c in requests.columns if c != "req"]), "req", "left")


def merged(requests: DataFrame, events: DataFrame, key: str, request_time: str, event_time: str) -> DataFrame:
    """Requests and events of all keys in one table: key, at, kind (0 request, 1 event), request, event.

    In order of (at, kind) every event of a request's past comes before it, and none of its own second.
    """
    a = requests.select(F.col(key), F.col(request_time).alias("at"), F.lit(0).alias("kind"), F.struct("*").alias("request"))
    b = events.select(F.col(key), F.col(event_time).alias("at"), F.lit(1).alias("kind"), F.struct("*").alias("event"))
    return a.unionByName(b, allowMissingColumns=True)


def prefix_sums(rows: DataFrame, key: list[str], time: str, order: list[Column], bucket: int, **amounts: Column) -> DataFrame:
    """``rows`` with, for each amount, its sum over the key's earlier rows in ``order``."""
    rows = rows.withColumn("_bucket", F.expr(f"{time} div {bucket}"))
    sums = rows.groupBy(*key, "_bucket").agg(*[F.sum(x).alias(f"_{n}") for n, x in amounts.items()])
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*key, "_bucket", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in amounts])
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(bases, [*key, "_bucket"])
    for name, amount in amounts.items():
        joined = joined.withColumn(name, F.col(f"_{name}") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return joined.drop("_bucket", *[f"_{n}" for n in amounts])


def last_before(rows: DataFrame, key: list[str], time: str, order: list[Column], bucket: int, value: Column) -> DataFrame:
    """``rows`` with ``last``: the greatest ``value`` (nulls left out) of the key's earlier rows in ``order``."""
    rows = rows.withColumn("_bucket", F.expr(f"{time} div {bucket}")).withColumn("_value", value)
    tops = rows.groupBy(*key, "_bucket").agg(F.max("_value").alias("_top"))
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*key, "_bucket", F.max("_top").over(earlier).alias("_top"))
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(tops, [*key, "_bucket"])
    return joined.withColumn("last", F.greatest(F.max("_value").over(inside), F.col("_top"))).drop("_bucket", "_value", "_top")


def last_n(joined: DataFrame, request: list[str], order: list[Column], n: int) -> DataFrame:
    """The ``n`` last rows of each request, with ``place`` counted back from 1."""
    w = Window.partitionBy(*request).orderBy(*order)
    return joined.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
