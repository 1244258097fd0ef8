"""Off-policy estimates and position bias over slot logs: request, position, item, explored, propensity, reward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched(log: DataFrame, target: DataFrame) -> DataFrame:
    """The log with ``target_rank``: the place of its item in the target's slate (request, item, rank), or null."""
    wanted = target.select("request", "item", F.col("rank").alias("target_rank"))
    return log.join(wanted, ["request", "item"], "left")


def estimates(log: DataFrame, slots: DataFrame, **estimators: tuple[Column, Column, Column, bool]) -> DataFrame:
    """(estimator, value, n_slots, n_matched, ess, coverage) for each (scope, used, weight, normalised).

    value is the sum of weight and reward over the sum of weights, or over the target's slots (request, n_slots) of
    the log's requests. Everything comes from one pass over sums by request, then one row.
    """
    def sums(name: str, scope: Column, use: Column, weight: Column) -> list[Column]:
        w = F.when(scope & F.coalesce(use, F.lit(False)), weight).otherwise(0.0)
        return [
            F.sum(w * F.col("reward")).alias(f"{name}_num"), F.sum(w).alias(f"{name}_w"), F.sum(w * w).alias(f"{name}_w2"),
            F.count_if(scope).alias(f"{name}_n"), F.count_if(scope & F.coalesce(use, F.lit(False))).alias(f"{name}_m"),
        ]

    parts = [c for name, (scope, use, weight, _) in estimators.items() for c in sums(name, scope, use, weight)]
    by_request = log.groupBy("request").agg(*parts).join(slots, "request", "left").na.fill(0, ["n_slots"])
    total = by_request.agg(*[F.sum(c).alias(c) for c in by_request.columns if c != "request"])
    rows = []
    for name, (_, _, _, normalised) in estimators.items():
        below = F.col(f"{name}_w") if normalised else F.col("n_slots").cast("double")
        rows.append(F.struct(
            F.lit(name).alias("estimator"), F.when(below > 0, F.col(f"{name}_num") / below).alias("value"),
            F.col(f"{name}_n").alias("n_slots"), F.col(f"{name}_m").alias("n_matched"),
            F.when(F.col(f"{name}_w2") > 0, F.col(f"{name}_w") ** 2 / F.col(f"{name}_w2")).otherwise(0.0).alias("ess"),
            F.when(F.col("n_slots") > 0, F.col(f"{name}_w") / F.col("n_slots")).alias("coverage"),
        ))
    return total.select(F.inline(F.array(*rows)))


def position_bias_eta(by_position: DataFrame, steps: int = 3001, upto: float = 3.0) -> DataFrame:
    """(eta) of the power law of position bias by Poisson profile likelihood over a grid.

    ``by_position`` has position, clicks, slots; it is one row a position, and the grid meets it as an array.
    """
    rows = by_position.agg(F.collect_list(F.struct(F.log(F.col("position") + 1.0).alias("lr"), "clicks", "slots")).alias("p"), F.sum("clicks").alias("c"))
    grid = rows.select("p", "c", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i")).withColumn("eta", F.col("i") * upto / (steps - 1))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda t, x: t + f(x))
    grid = grid.withColumn("exposure", total(lambda x: x["slots"] * F.exp(-F.col("eta") * x["lr"])))
    grid = grid.withColumn("ranks", total(lambda x: x["clicks"] * x["lr"]))
    scale = F.col("c") / F.col("exposure")
    fit = F.col("c") * F.log(scale) - F.col("eta") * F.col("ranks") - scale * F.col("exposure")
    best = grid.where("c > 0").agg(F.max(F.struct(F.round(fit, 9).alias("fit"), (-F.col("eta")).alias("least"))).alias("b"))
    return best.select((-F.col("b.least")).alias("eta"))
