"""Training and evaluation sets from logs: repeatable samples, splits and pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.scores import md5_number
from plumeria.operators import asof


def first_by_hash(df: DataFrame, group: list[str], n: Column | int, seed: int, *key: str) -> DataFrame:
    """A repeatable sample: the n rows of each group with the least hashes of seed and key."""
    order = [md5_number(F.lit(seed), *map(F.col, key)), *map(F.col, key)]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def pool(requests: DataFrame, items: DataFrame, t: str, published: str, window: int) -> DataFrame:
    """Requests with the items published in ``[t - window, t]``, joined by time bins of the window's size."""
    bins = F.array(F.expr(f"({t} - {window}) div {window}"), F.expr(f"{t} div {window}"))
    dealt = requests.withColumn("_bin", F.explode(F.array_distinct(bins)))
    placed = items.withColumn("_at", F.expr(f"{published} div {window}"))
    match = (F.col("_bin") == F.col("_at")) & F.col(published).between(F.col(t) - window, F.col(t))
    return dealt.join(placed, match).drop("_bin", "_at")


def unseen(pool_: DataFrame, seen: DataFrame, user: str, item: str, t: str, s: str) -> DataFrame:
    """Without the items that the user met before the request: the first meeting of each (user, item) decides."""
    firsts = seen.groupBy(user, item).agg(F.min(s).alias("_first"))
    joined = pool_.join(firsts, [user, item], "left")
    return joined.where(F.col("_first").isNull() | (F.col("_first") >= F.col(t))).drop("_first")


def group_safe_split(df: DataFrame, group: str, time: str, share: float) -> DataFrame:
    """``part`` (train or valid): groups in order of first time, cut where their rows come nearest to the share.

    One row a group goes through the prefix sums, dealt by day; the rows don't.
    """
    groups = df.groupBy(group).agg(F.min(time).alias("_t"), F.count("*").alias("_n"))
    placed = asof.prefix_sums(groups, [], "_t", [F.col("_t"), F.col(group)], 86400, before=F.col("_n"))
    placed = placed.withColumn("_upto", F.col("before") + F.col("_n"))
    total = groups.agg(F.sum("_n").alias("_total"))
    far = F.abs(F.col("_upto") - F.col("_total") * share)
    cut = placed.join(F.broadcast(total)).agg(F.min(F.struct(far.alias("_far"), "_upto"))["_upto"].alias("_cut"))  # one row each
    sides = placed.join(F.broadcast(cut)).select(group, F.when(F.col("_upto") <= F.col("_cut"), "train").otherwise("valid").alias("part"))
    return df.join(sides, group)


def time_block(t: Column, start: int, size: int) -> Column:
    return F.floor((t - start) / size)


def largest_remainder(strata: DataFrame, size: str, total: int) -> DataFrame:
    """``take`` for each stratum (one row each): its share of ``total``, the rest to the largest fractions."""
    share = F.col(size) * F.lit(float(total)) / F.sum(size).over(Window.partitionBy())
    base = strata.withColumn("_floor", F.floor(share)).withColumn("_rest", F.round(share - F.floor(share), 9))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    name = [c for c in strata.columns if c != size][0]
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), name))
    return base.withColumn("take", (F.col("_floor") + (place <= left).cast("long"))).drop("_floor", "_rest")
