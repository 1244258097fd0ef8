"""Weights of a linear score by pairwise conditional logistic regression, fitted by distributed Newton steps.

In each group every positive row is held against every negative one; a group's pairs weigh 1 together. The pairs are
made in the tasks, from the rows of very many small groups or of a block of a large one at a time, and add up to one
loss, gradient and Hessian a task: no table of pairs exists. The driver solves for the step from these few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positive rows that meet a group's negative rows at once.
BLOCK = 256
#: Pairs of whole groups that are made at once.
TOGETHER = 1 << 16
#: Step lengths that are tried in one pass where the whole step doesn't lower the loss enough.
_SHORTER = tuple(0.5**k for k in range(1, 27))


@dataclass(frozen=True)
class Fit:
    """Weights, groups with pairs, pairs, Newton steps, whether they came to rest, and the loss there."""

    weights: list[float]
    groups: int
    pairs: int
    steps: int
    converged: bool
    loss: float | None


def _lists(rows: DataFrame, group: str, features: str, label: str) -> DataFrame:
    """(positive, negative, n): flat features of both kinds, one row a group that has both."""
    good = rows.where(F.col(group).isNotNull() & F.col(features).isNotNull() & F.col(label).isNotNull())
    own = good.select(F.col(group).alias("_g"), F.col(features).cast("array<double>").alias("_x"), (F.col(label) != 0).alias("_y"))
    lists = own.groupBy("_g").agg(*[F.flatten(F.collect_list(F.when(y, F.col("_x")))).alias(n) for n, y in (("positive", F.col("_y")), ("negative", ~F.col("_y")))], F.max(F.size("_x")).alias("size"))
    return lists.where("size(positive) > 0 AND size(negative) > 0").drop("_g")


def _differences(batch: pa.RecordBatch, size: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positive less negative row, weight) for all pairs of a batch of groups: small groups together, large ones in blocks."""
    sides = []
    for name in ("positive", "negative"):
        column = batch.column(name)
        rows = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // size
        sides.append((column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size), rows, np.cumsum(rows) - rows))
    (positive, p, p_at), (negative, n, n_at) = sides
    pairs = p * n
    for k in np.flatnonzero(pairs > TOGETHER):
        against = negative[n_at[k] : n_at[k] + n[k]]
        for at in range(p_at[k], p_at[k] + p[k], block):
            d = (positive[at : min(at + block, p_at[k] + p[k]), None] - against[None]).reshape(-1, size)
            yield d, np.full(len(d), 1.0 / pairs[k])
    small = np.flatnonzero(pairs <= TOGETHER)
    if len(small):
        ends = np.cumsum(pairs[small])
        for own in np.split(small, np.flatnonzero(np.diff(ends // TOGETHER)) + 1):
            group = np.repeat(own, pairs[own])
            place = np.arange(len(group)) - np.repeat(np.cumsum(pairs[own]) - pairs[own], pairs[own])
            yield positive[p_at[group] + place // n[group]] - negative[n_at[group] + place % n[group]], 1.0 / pairs[group]


def _sums(lists: DataFrame, points: np.ndarray, whole: bool, block: int) -> tuple[np.ndarray, int, int]:
    """(sums, groups, pairs): the losses at all points and, if ``whole``, gradient and Hessian at the first."""
    size = points.shape[1]
    width = len(points) + (size + size * size) * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, groups, pairs = np.zeros(width), 0, 0
        for batch in batches:
            groups += batch.num_rows
            for d, a in _differences(batch, size, block):
                pairs += len(d)
                z = d @ points.T
                total[: len(points)] += a @ np.logaddexp(0.0, -z)
                if whole:
                    s = 0.5 - 0.5 * np.tanh(0.5 * z[:, 0])  # sigma(-z), without overflow
                    total[len(points) : len(points) + size] -= (a * s) @ d
                    total[len(points) + size :] += ((d.T * (a * s * (1 - s))) @ d).ravel()
        yield pa.RecordBatch.from_pylist([{"sums": total.tolist(), "groups": groups, "pairs": pairs}])

    tasks = lists.select("positive", "negative").mapInArrow(run, "sums array<double>, groups long, pairs long").collect()  # one row a task
    return np.sum([r["sums"] for r in tasks], axis=0) if tasks else np.zeros(width), sum(r["groups"] for r in tasks), sum(r["pairs"] for r in tasks)


def fit(rows: DataFrame, group: str, features: str, label: str, l2: float = 1e-6, steps: int = 100, rest: float = 1e-10, block: int = BLOCK) -> Fit:
    """Weights without constant that minimise the mean over groups of the mean pair loss, plus l2/2 times their square.

    Rows with a null group, features or label are left out, and groups without both labels make no pairs; without any
    pairs there are no weights. A group's rows, a request's candidates, are held by one task; the features all have the
    length of the first. Newton's step is halved until the loss falls by Armijo's rule; the lengths are tried together.
    """
    lists = _lists(rows, group, features, label).persist()
    try:
        first = lists.select("size").first()
        if first is None:
            return Fit([], 0, 0, 0, False, None)
        size = first["size"]
        w = np.zeros(size)

        def at(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            sums, _, _ = _sums(lists, point[None], True, block)
            sums = sums / groups
            return sums[0] + 0.5 * l2 * point @ point, sums[1 : 1 + size] + l2 * point, sums[1 + size :].reshape(size, size) + l2 * np.eye(size)

        _, groups, pairs = _sums(lists, w[None], False, block)
        loss, gradient, hessian = at(w)
        for k in range(1, steps + 1):
            step = np.linalg.solve(hessian, -gradient)
            to, new = w + step, at(w + step)
            if not new[0] <= loss + 1e-4 * gradient @ step:
                sums, _, _ = _sums(lists, np.array([w + t * step for t in _SHORTER]), False, block)
                losses = [x / groups + 0.5 * l2 * (w + t * step) @ (w + t * step) for x, t in zip(sums, _SHORTER, strict=True)]
                t = next((t for x, t in zip(losses, _SHORTER, strict=True) if x <= loss + 1e-4 * t * gradient @ step), _SHORTER[-1])
                to = w + t * step
                new = at(to)
            done = np.abs(to - w).max() < rest
            w, (loss, gradient, hessian) = to, new
            if done:
                return Fit(w.tolist(), groups, pairs, k, True, float(loss))
        return Fit(w.tolist(), groups, pairs, steps, False, float(loss))
    finally:
        lists.unpersist()
