"""Exact percentiles of hot groups: a mergeable sketch brackets each rank, and only the values in the bracket are ranked.

The sketch (``percentile_approx``) has bounded state and a rank error of at most 1 in ``ACCURACY`` of a group. One more
pass counts what lies below each bracket and gathers the values in it, equal ones as one row with their number, so no
task holds a group: a window ranks some ``2 * MARGIN`` of a group's distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's accuracy, and how far a bracket reaches to both sides of its rank; ten times the sketch's error.
ACCURACY, MARGIN = 10_000, 0.001


def percentiles(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, share, n, percentile) for each group and share: linear between the two values around share * (n - 1).

    Null values don't count, a group without values has no rows; null is a group too. Equal values may be very many.
    """
    one = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    clip = lambda x: float(min(1.0, max(0.0, x)))
    ends = [clip(q + d) for q in shares for d in (-MARGIN, MARGIN)]
    brackets = one.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("e"))
    parts = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.get("e", F.lit(2 * i)).alias("low"), F.get("e", F.lit(2 * i + 1)).alias("high")) for i, q in enumerate(shares)])
    brackets = brackets.select(F.col("g").alias("of"), F.col("n").alias("n"), F.inline(parts))
    # A value counts as itself in its bracket, and as the bracket's neighbour outside; equal ones fall together first.
    values = one.groupBy("g", "v").agg(F.count("*").alias("k"))
    met = values.join(brackets, F.col("g").eqNullSafe(F.col("of"))).withColumn("side", F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0))
    inside = met.where("side = 0").select("g", "share", "n", "v", "k", "side")
    outside = met.where("side <> 0").groupBy("g", "share", "n", "side").agg(F.when(F.col("side") < 0, F.max("v")).otherwise(F.min("v")).alias("v"), F.sum("k").alias("k"))
    few = inside.unionByName(outside.select("g", "share", "n", "v", "k", "side"))
    last = F.sum("k").over(Window.partitionBy("g", "share").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - 1
    ranked = few.withColumn("last", last).withColumn("first", F.col("last") - F.col("k") + 1)
    # Of what lies outside only the value next to the bracket is known.
    ranked = ranked.withColumn("first", F.when(F.col("side") < 0, F.col("last")).otherwise(F.col("first"))).withColumn("last", F.when(F.col("side") > 0, F.col("first")).otherwise(F.col("last")))
    at = F.col("share") * (F.col("n") - 1)
    holds = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))
    found = ranked.withColumn("at", at).groupBy("g", "share", "n").agg(holds(F.floor("at")).alias("a"), holds(F.ceil("at")).alias("b"), F.first("at").alias("at"))
    return found.select(F.col("g").alias(by), "share", "n", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("percentile"))
