"""Roots of means over a table: many points of a bracket are valued in one scan, so few scans find a root."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that one scan values, and the bracket that a bias is looked for in.
POINTS, BRACKET = 64, (-40.0, 40.0)


def calibrated(scores: DataFrame, column: str, target: float, within: float = 1e-9, points: int = POINTS) -> tuple[float, float]:
    """(bias, rate): the mean of sigma(score + bias) over all rows is ``target``, to ``within`` in the bias.

    The mean grows with the bias, so of the points of a scan two neighbours enclose the root and the next scan looks
    between them: six scans for nine digits. Null scores are left out; a table without scores, and a target that isn't
    between 0 and 1, are errors.
    """
    if not 0 < target < 1:
        raise ValueError("the target must lie between 0 and 1")
    low, high = BRACKET
    while True:
        at = np.linspace(low, high, points)
        means = scores.where(F.col(column).isNotNull()).agg(F.array(*[F.avg(1 / (1 + F.exp(-(F.col(column) + float(b))))) for b in at]).alias("r")).first()["r"]
        if means[0] is None:
            raise ValueError("no scores")
        k = int(np.searchsorted(means, target))
        if k in (0, points):
            raise ValueError("no bias of the bracket gives the target")
        low, high = float(at[k - 1]), float(at[k])
        if high - low <= within:
            share = (target - means[k - 1]) / (means[k] - means[k - 1]) if means[k] > means[k - 1] else 0.5
            return low + share * (high - low), means[k]
