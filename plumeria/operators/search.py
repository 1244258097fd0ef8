"""Searches over declared spaces of configurations, and verdicts that must hold from some size on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SIXTEEN = float(16**15)


def drawn(name: str, number: Column) -> Column:
    """A number of [0, 1) from the MD5 of a parameter's name and a configuration's number: reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}:"), number.cast("string"))), 1, 15), 16, 10).cast("double") / _SIXTEEN


def configurations(spark: SparkSession, n: int, space: dict[str, tuple[float, float, str]]) -> DataFrame:
    """(config, parameters...): ``n`` draws from a space of (low, high, 'uniform' or 'log')."""
    one = F.col("config")
    columns = []
    for name, (low, high, scale) in space.items():
        if scale == "log":
            columns.append(F.exp(F.lit(math.log(low)) + drawn(name, one) * (math.log(high) - math.log(low))).alias(name))
        else:
            columns.append((F.lit(low) + drawn(name, one) * (high - low)).alias(name))
    return spark.range(n).select(F.col("id").alias("config")).select("config", *columns)


def searched(rows: DataFrame, configs: DataFrame, score: Column, label: str) -> DataFrame:
    """(config, parameters..., evaluated, fit, place): how well each configuration's score goes with the label.

    All configurations, a table of declared size, meet every row in one scan and are aggregated before any shuffle;
    each is valued on the same rows, which ``evaluated`` tells. Rows with a null score or label aren't valued. The fit
    is Pearson's, null where the score doesn't vary; places go by the fit, rounded to nine digits, then by number.
    """
    names = configs.columns
    both = rows.join(F.broadcast(configs)).withColumn("score", score).where(F.col("score").isNotNull() & F.col(label).isNotNull())
    sums = both.groupBy(*names).agg(F.count("*").alias("evaluated"), F.corr("score", F.col(label).cast("double")).alias("fit"))
    order = Window.orderBy(F.round("fit", 9).desc_nulls_last(), "config")  # one row a configuration
    return sums.withColumn("place", F.row_number().over(order).cast("long"))


def smallest_that_holds(verdicts: DataFrame, size: str, holds: str, by: list[str] | None = None) -> DataFrame:
    """(by..., smallest): the least size from which on the verdict holds at every size; null if not at the largest.

    A null verdict doesn't hold. Sizes that several rows have hold if all of them do.
    """
    by = by or []
    one = verdicts.groupBy(*by, size).agg(F.bool_and(F.coalesce(F.col(holds), F.lit(False))).alias("_holds"))
    last = one.groupBy(*by).agg(F.max(F.when(~F.col("_holds"), F.col(size))).alias("_last"), F.sort_array(F.collect_list(size)).alias("_sizes"))  # sizes are few
    above = F.filter("_sizes", lambda x: F.col("_last").isNull() | (x > F.col("_last")))
    return last.select(*by, F.get(above, F.lit(0)).alias("smallest"))
