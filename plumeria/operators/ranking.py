"""Ranking within groups, and metrics of ranked groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.scores import md5_number


def ranked(df: DataFrame, group: list[str], score: str, item: str, seed: int = 0) -> DataFrame:
    """``rank`` from 0 by falling score; ties are broken by a repeatable hash of seed and item."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), md5_number(F.lit(seed), F.col(item)), F.col(item))
    return df.withColumn("rank", F.row_number().over(w) - 1)


def top_items(df: DataFrame, group: list[str], k: int, item: str = "item") -> DataFrame:
    """The first k items of each group of a ranked table as an array in order."""
    top = df.where(F.col("rank") < k).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", item))).alias("l"))
    return top.select(*group, F.transform("l", lambda x: x[item]).alias("items"))


def average_rank(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``average_rank`` scaled to 0 .. 1, ties averaged, 0.5 for a group of one; null stays null."""
    known = Window.partitionBy(*group, F.col(value).isNull())
    n = F.count(value).over(known)
    first = F.rank().over(known.orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*group, value))
    scaled = F.when(n > 1, (first - 1 + (ties - 1) / 2) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.5))
    return df.withColumn("average_rank", F.when(F.col(value).isNotNull(), scaled))


def group_auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; null without both kinds.

    Labels are first counted by (group, score), so the window runs over distinct scores.
    """
    by_score = df.groupBy(*group, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    below = Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") / 2)
    sums = by_score.withColumn("won", won).groupBy(*group).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(*group, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + F.lit(2.0))


def ideal_gain(n: Column, k: int) -> Column:
    """The greatest discounted gain at k with n positives."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n.cast("int"), F.lit(k)))), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + F.lit(1.0)))


def ranking_metrics(df: DataFrame, group: list[str], label: str, k: int, total: str | None = None) -> DataFrame:
    """MRR, nDCG@k and recall@k of groups of a ranked table; null without positives.

    ``total`` names a column with a group's number of positives that counts those outside of the pool as well.
    """
    hit = (F.col(label) == 1) & (F.col("rank") < k)
    n = F.max(total) if total else F.sum(label)
    sums = df.groupBy(*group).agg(
        n.alias("n_pos"),
        F.min(F.when(F.col(label) == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(hit, discount(F.col("rank"))).otherwise(0.0)).alias("gain"),
        F.sum(hit.cast("int")).alias("hits"),
    )
    some = F.col("n_pos") > 0
    return sums.select(
        *group,
        F.when(some, F.coalesce(1 / (F.col("first") + 1), F.lit(0.0))).alias("mrr"),
        F.when(some, F.col("gain") / ideal_gain(F.col("n_pos"), k)).alias("ndcg"),
        F.when(some, F.col("hits") / F.col("n_pos")).alias("recall"),
    )
