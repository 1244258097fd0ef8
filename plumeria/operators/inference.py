"""Resampling by cluster: sums of each cluster in Spark, then weights drawn on the driver's few numbers a cluster.

The number of clusters may be large, so the draws are made in Spark as well: a cluster's Poisson weight of a
replicate comes from a repeatable hash, and each replicate is one sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.scores import md5_number
from plumeria.operators import rounds

#: Cumulative Poisson probabilities with mean 1, up to 7 (fixed values).
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def poisson_weight(seed: int, replicate: Column, cluster: Column) -> Column:
    """A repeatable Poisson(1) draw for a cluster in a replicate."""
    u = md5_number(F.lit(seed), replicate, cluster) / F.lit(4294967296.0)
    draw = F.lit(0)
    for p in POISSON:
        draw = draw + (u >= p).cast("int")
    return draw


def cluster_bootstrap(sums: DataFrame, cluster: str, num: str, den: str, replicates: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(value, low, high): the ratio of sums and its percentile interval when clusters are drawn anew.

    The replicates of a cluster's row are partial sums of its own map task, so the shuffle holds one row a replicate
    and task.
    """
    drawn = sums.select(cluster, num, den, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    w = poisson_weight(seed, F.col("b"), F.col(cluster))
    each = drawn.groupBy("b").agg(F.sum(w * F.col(num)).alias("n"), F.sum(w * F.col(den)).alias("d"))
    ratios = each.where("d > 0").agg(F.percentile(F.col("n") / F.col("d"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    whole = sums.agg((F.sum(num) / F.sum(den)).alias("value"))
    return whole.join(F.broadcast(ratios)).select("value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # one row each


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "better").when(high < 0, "worse").otherwise("undecided")


def cluster_bootstrap_by(sums: DataFrame, by: str, cluster: str, num: str, den: str, replicates: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(by, value, low, high): ``cluster_bootstrap`` for each value of ``by``, with the same draws of clusters in all."""
    drawn = sums.select(by, cluster, num, den, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    w = poisson_weight(seed, F.col("b"), F.col(cluster))
    each = drawn.groupBy(by, "b").agg(F.sum(w * F.col(num)).alias("n"), F.sum(w * F.col(den)).alias("d")).where("d > 0")
    quantiles = F.percentile(F.col("n") / F.col("d"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    whole = sums.groupBy(by).agg((F.sum(num) / F.sum(den)).alias("value"))
    return whole.join(each.groupBy(by).agg(quantiles.alias("q")), by).select(by, "value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def nested_bootstrap(cells: DataFrame, inner: str, outer: str, num: str, den: str, replicates: int = 200, alpha: float = 0.05) -> DataFrame:
    """(value, replicates, low, high): the ratio of sums when both kinds of cluster are drawn anew.

    ``cells`` has sums by (inner, outer); a cell weighs the product of both draws. Replicates without weight are left out.
    """
    drawn = cells.select(inner, outer, num, den, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    w = poisson_weight(0, F.col("b"), F.col(inner)) * poisson_weight(1, F.col("b"), F.col(outer))
    each = drawn.groupBy("b").agg(F.sum(w * F.col(num)).alias("n"), F.sum(w * F.col(den)).alias("d")).where("d > 0")
    ratios = each.agg(F.count("*").alias("replicates"), F.percentile(F.col("n") / F.col("d"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    whole = cells.agg((F.sum(num) / F.sum(den)).alias("value"))
    return whole.join(F.broadcast(ratios)).select("value", "replicates", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # one row each


def gate(low: Column, high: Column, margin: float) -> Column:
    """Non-inferiority of an interval: pass above the margin, fail below it, else hold."""
    return F.when(low > -margin, "pass").when(high < -margin, "fail").otherwise("hold")


def two_sided_p(z: Column) -> Column:
    """The two-sided p-value of a normal statistic, by a logistic approximation (within 0.0002)."""
    x = F.abs(z)
    return 2 / (1 + F.exp(1.5976 * x + 0.07056 * x**3))


def holm(family: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """``adjusted`` and ``rejected`` by Holm's step-down; the windows run over the family's few rows."""
    order = Window.orderBy(p, name)
    ranked = family.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    step = F.max((F.col("_m") - F.col("_i") + 1) * F.col(p)).over(Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), step)).withColumn("rejected", step < alpha).drop("_i", "_m")


def weighted_kappa(rows: DataFrame, one: str, two: str) -> DataFrame:
    """(n, unweighted, linear, quadratic): Cohen's kappa of two judges' grades by three weights of their difference.

    Grades are whole numbers; rows where either is null are left out. One count for each pair of grades is all that is
    shuffled. A kappa is null where both judges give one grade only, and n 0 without rows.
    """
    counts = rows.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(F.col(one).alias("x"), F.col(two).alias("y")).agg(F.count("*").alias("n"))
    first, second = counts.groupBy("x").agg(F.sum("n").alias("p")), counts.groupBy("y").agg(F.sum("n").alias("q"))
    apart = F.abs(F.col("x") - F.col("y")).cast("double")
    weights = {"unweighted": (apart > 0).cast("double"), "linear": apart, "quadratic": apart * apart}
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(w * F.col("n")).alias(f"o_{k}") for k, w in weights.items()])  # one row
    expected = first.join(second.hint("broadcast"), how="cross").agg(*[F.sum(w * F.col("p") * F.col("q")).alias(f"e_{k}") for k, w in weights.items()])  # grades squared
    both = seen.join(F.broadcast(expected))
    return both.select("n", *[F.when(F.col(f"e_{k}") > 0, 1 - F.col(f"o_{k}") * F.col("n") / F.col(f"e_{k}")).alias(k) for k in weights])


def self_preference(
    rows: DataFrame, cluster: str, generator: str, judge: str, family: str, judge_score: str, human_score: str, reference: str, replicates: int = 200, seed: int = 0, alpha: float = 0.05,
) -> DataFrame:
    """(judge, family, n, own_gap, reference_gap, contrast, low, high): how much more a judge favours its own family than the reference judge does.

    A row's error is the judge's score less the human one, each standardised over the judge's rows (0 where they don't
    vary). A gap is the mean error of texts from a family less that of all others; the contrast is the judge's gap less
    the reference judge's for the same family. The interval is of percentiles of the contrast with clusters drawn anew,
    by the same draws for both judges; draws that lack one of the four means are left out.

    Rows with a null column are left out. Judges whose family made no text have no row, nor has any without rows of the
    reference judge; a judge's family is the least of its rows'. A cell of (judge, cluster, generator) is one row before
    anything is drawn, and what is left after it is one row for each judge, generator and draw.
    """
    named = {"c": cluster, "g": generator, "j": judge, "f": family, "x": judge_score, "y": human_score}
    own = rows.select(*[F.col(v).alias(k) for k, v in named.items()]).dropna().withColumns({k: F.col(k).cast("double") for k in "xy"})
    scale = own.groupBy("j").agg(*[f(k).alias(f"{n}{k}") for k in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.min("f").alias("f"), F.count("*").alias("rows"))
    cells = own.groupBy("j", "c", "g").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n")).join(scale.drop("f", "rows"), "j")
    z = lambda k: F.when(F.col(f"s{k}") > 0, (F.col(k) - F.col("n") * F.col(f"m{k}")) / F.col(f"s{k}")).otherwise(0.0)
    # A cluster's cells, no more than judges times generators, share its draws; draw 0 is the sample itself.
    of = cells.groupBy("c").agg(F.collect_list(F.struct("j", "g", "n", (z("x") - z("y")).alias("e"))).alias("cells"))
    drawn = of.select("c", "cells", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("b"))
    weighed = drawn.withColumn("w", F.when(F.col("b") == 0, 1).otherwise(poisson_weight(seed, F.col("b"), F.col("c")))).where("w > 0").select("b", "w", F.inline("cells"))
    sums = rounds.cut(weighed.groupBy("j", "g", "b").agg(F.sum(F.col("w") * F.col("e")).alias("e"), F.sum(F.col("w") * F.col("n")).alias("n")))
    all_ = sums.groupBy("j", "b").agg(F.sum("e").alias("all_e"), F.sum("n").alias("all_n"))
    part = sums.join(all_, ["j", "b"])
    mean = lambda e, n: F.when(n > 0, e / n)
    gap = mean(F.col("e"), F.col("n")) - mean(F.col("all_e") - F.col("e"), F.col("all_n") - F.col("n"))
    gaps = part.select("j", F.col("g").alias("f"), "b", gap.alias("gap"))
    judges = scale.where(F.col("j") != reference).select("j", "f", "rows")
    mine = gaps.join(judges, ["j", "f"])
    both = mine.join(gaps.where(F.col("j") == reference).select("f", "b", F.col("gap").alias("ref")), ["f", "b"])
    first = lambda c: F.max(F.when(F.col("b") == 0, c))
    contrast = F.col("gap") - F.col("ref")
    found = both.groupBy("j", "f").agg(
        F.max("rows").alias("n"), first(F.col("gap")).alias("own_gap"), first(F.col("ref")).alias("reference_gap"), first(contrast).alias("contrast"),
        F.percentile(F.when(F.col("b") > 0, contrast), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"),
    )
    return found.select(F.col("j").alias("judge"), F.col("f").alias("family"), "n", "own_gap", "reference_gap", "contrast", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
