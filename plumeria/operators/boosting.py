"""Boosted ranking trees (LambdaRank) by histograms: features are binned once, and each level of a tree is one aggregate.

Lists, the rows of a group each, lie some thousand rows to a row of a table: bins, labels and scores as packed numbers, and
the lists' sizes. Lists of one size are handled by the same few numpy calls. For each tree every
list computes its rows' gradients from its own order; for each level the tasks add gradients up by (node, feature, bin)
and Spark sums these cells, whose number the parameters bound. The driver picks splits from them. Gradients are whole
numbers of 2**-24, so any order of addition gives the same sums, and a rerun, the same trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.operators import rounds

#: Gradients are rounded to whole numbers of 1 / SCALE.
SCALE = 1 << 24
#: Trees between two cuts of the lineage, and rows of a list that meet all its rows at once.
CHUNK, BLOCK = 8, 256
#: Rows of lists that lie in one row of the table, unless a list alone has more, and pairs that are held at once.
ROWS, PAIRS = 1 << 13, 1 << 19
_STATE = "bins binary, labels binary, scores binary, g binary, h binary, sizes binary"


@dataclass(frozen=True)
class Tree:
    """Splits by heap place (feature -1: none, all go left), and one value a leaf."""

    feature: list[int]
    bin: list[int]
    value: list[float]

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The place within level ``depth`` that each row of bins comes to."""
        at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for level in range(depth):
            heap = at + (1 << level) - 1
            f, b = np.array(self.feature)[heap], np.array(self.bin)[heap]
            at = 2 * at + ((f >= 0) & (bins[every, np.maximum(f, 0)] > b))
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins, len(self.value).bit_length() - 1)]


@dataclass(frozen=True)
class Ranker:
    """Upper ends of each feature's bins, and the trees, whose values add up to a score."""

    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin 0 is for missing values, k for those above k - 1 of the ends."""
        out = np.zeros(x.shape, np.uint8)
        for f, ends in enumerate(self.edges):
            out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(ends, x[:, f]))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return sum((t.scores(bins) for t in self.trees), np.zeros(len(x)))

    def score(self, features: Column) -> Column:
        """The score of an array of features; a null array has none, further elements are left out."""
        model = self

        if not model.edges:
            return F.when(features.isNotNull(), F.lit(0.0))

        @F.arrow_udf("double")
        def run(column: pa.Array) -> pa.Array:
            return pa.array(model.scores(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(model.edges))))

        # Every row reaches the function, a null array as one of missing elements.
        return F.when(features.isNotNull(), run(_padded(features, len(self.edges))))


def _padded(x: Column, size: int) -> Column:
    return F.array(*[F.coalesce(F.get(x, F.lit(f)).cast("double"), F.lit(float("nan"))) for f in range(size)])


def gradients(labels: np.ndarray, scores: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of a list's loss: its pairs of unequal labels, by what swapping them does to nDCG.

    The pairs weigh 1 together. Equal scores rank by their place in the list.
    """
    n = len(labels)
    gain, g, h = 2.0**labels - 1, np.zeros(n), np.zeros(n)
    discount = np.empty(n)
    discount[np.argsort(-scores, kind="stable")] = 1 / np.log2(2 + np.arange(n))
    total = 0.0
    for at in range(0, n, block):
        i = slice(at, at + block)
        weight = np.where(labels[i, None] > labels, (gain[i, None] - gain) * np.abs(discount[i, None] - discount), 0.0)
        p = 0.5 - 0.5 * np.tanh(0.5 * (scores[i, None] - scores))  # sigma(s_j - s_i), without overflow
        first, second = weight * p, weight * p * (1 - p)
        g[i] -= first.sum(axis=1)
        h[i] += second.sum(axis=1)
        g += first.sum(axis=0)
        h += second.sum(axis=0)
        total += weight.sum()
    whole = lambda v: np.rint(v / total * SCALE).astype(np.int64) if total > 0 else np.zeros(n, np.int64)
    return whole(g), whole(h)


def all_gradients(labels: np.ndarray, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``gradients`` of lists that lie one behind the other; neighbours of one size, a block at most, go together."""
    g, h = np.empty(len(labels), np.int64), np.empty(len(labels), np.int64)
    runs = np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes)) + 1) if len(sizes) else []
    begin = 0
    for run in runs:
        n = int(sizes[run[0]])
        step = max(PAIRS // (n * n), 1) if n <= BLOCK else 1
        for at in range(0, len(run), step):
            k = min(step, len(run) - at)
            own = slice(begin, begin + k * n)
            begin += k * n
            if n > BLOCK:
                g[own], h[own] = gradients(labels[own], scores[own])
                continue
            y, s = labels[own].reshape(k, n), scores[own].reshape(k, n)
            gain, discount = 2.0**y - 1, np.empty((k, n))
            np.put_along_axis(discount, np.argsort(-s, axis=1, kind="stable"), np.broadcast_to(1 / np.log2(2 + np.arange(n)), (k, n)), axis=1)
            apart = lambda v: v[:, :, None] - v[:, None, :]
            weight = np.where(apart(y) > 0, apart(gain) * np.abs(apart(discount)), 0.0)
            p = 0.5 - 0.5 * np.tanh(0.5 * apart(s))
            first, second = weight * p, weight * p * (1 - p)
            total = weight.reshape(k, -1).sum(axis=1)[:, None]
            sums = 0.0 - first.sum(axis=2) + first.sum(axis=1), second.sum(axis=2) + second.sum(axis=1)
            for out, v in zip((g, h), sums, strict=True):
                out[own] = np.where(total > 0, np.rint(v / np.where(total > 0, total, 1.0) * SCALE), 0.0).astype(np.int64).ravel()
    return g, h


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float, least: int) -> tuple[int, int]:
    """(feature, bin) of the greatest gain among cells (feature, bin) of one node; (-1, 0) where no split gains.

    Ties fall to the least feature, then the least bin.
    """
    left, all_ = [np.cumsum(c, axis=1) for c in (g, h, n)], [c[0].sum() for c in (g, h, n)]
    right = [a - c for a, c in zip(all_, left, strict=True)]
    worth = lambda a, b: (a / SCALE) ** 2 / (b / SCALE + l2)
    gain = worth(left[0], left[1]) + worth(right[0], right[1]) - worth(all_[0], all_[1])
    gain = np.where((left[2] >= least) & (right[2] >= least), gain, 0.0)
    at = int(np.argmax(gain))
    return (at // gain.shape[1], at % gain.shape[1]) if gain.flat[at] > 1e-12 else (-1, 0)


def _lists(own: DataFrame, size: int, limit: int) -> DataFrame:
    """(y, x): labels and flat features of each list, in the order of the keys' hashes."""
    parts = own.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    parts = parts.select(F.col("g").alias("of"), F.ceil(F.col("n") / limit).alias("parts"))
    dealt = own.join(parts, F.col("g") == F.col("of"), "left").withColumn("part", F.pmod(F.xxhash64("k"), F.coalesce("parts", F.lit(1))))
    one = F.struct(F.xxhash64(F.lit(1), F.col("k")).alias("a"), "k", "y", _padded(F.col("x"), size).alias("x"))
    lists = dealt.groupBy("g", "part").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    return lists.select(F.col("rows.y").alias("y"), F.flatten("rows.x").alias("x"))


def _packed(lists: DataFrame, ranker: Ranker) -> DataFrame:
    size = len(ranker.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("y")).to_numpy(zero_copy_only=False).astype(np.int64)
            labels = batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(np.int8)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            begins, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
            ends = np.cumsum(sizes[order])
            for own in np.split(order, np.flatnonzero(np.diff((ends - 1) // ROWS)) + 1) if len(order) else []:
                n = sizes[own]
                rows = np.repeat(begins[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield _row(ranker.bins(x[rows]), labels[rows], np.zeros(len(rows)), b"", b"", n.astype(np.int32))

    return lists.mapInArrow(run, _STATE)


def _row(bins: np.ndarray, labels: np.ndarray, scores: np.ndarray, g: bytes, h: bytes, sizes: np.ndarray) -> pa.RecordBatch:
    values = (bins.tobytes(), labels.tobytes(), scores.tobytes(), g, h, sizes.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["bins", "labels", "scores", "g", "h", "sizes"])


def _unpacked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    kinds = {"bins": np.uint8, "labels": np.int8, "scores": np.float64, "g": np.int64, "h": np.int64, "sizes": np.int32}
    for batch in batches:
        for k in range(batch.num_rows):
            bins, *rest = (np.frombuffer(batch[name][k].as_py(), kind) for name, kind in kinds.items())
            yield bins.reshape(-1, size), *rest


def _advance(size: int, tree: Tree | None) -> Callable:
    """Scores with one more tree, and the gradients there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, labels, scores, _, _, sizes in _unpacked(batches, size):
            now = scores if tree is None else scores + tree.scores(bins)
            g, h = all_gradients(labels.astype(float), now, sizes)
            yield _row(bins, labels, now, g.tobytes(), h.tobytes(), sizes)

    return run


def _cells(state: DataFrame, size: int, width: int, tree: Tree, depth: int) -> np.ndarray:
    """Sums of gradient, its derivative and rows as (3, node, feature, bin) at one level of a growing tree."""
    shape = (1 << depth, size, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = np.zeros((3, np.prod(shape)), np.int64), False
        for bins, _, _, g, h, _ in _unpacked(batches, size):
            cell = ((tree.nodes(bins, depth)[:, None] * size + np.arange(size)) * width + bins).ravel()
            for out, v in zip(sums, (g, h, np.ones(len(g), np.int64)), strict=True):
                out += np.bincount(cell, np.repeat(v, size).astype(float), out.size).astype(np.int64)  # a row's sums are exact
            some = True
        if some:
            at = np.flatnonzero(sums[2])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (at, *sums[:, at])], ["cell", "g", "h", "n"])

    rows = state.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()  # nodes x features x bins at most
    out = np.zeros((3, np.prod(shape)), np.int64)
    for cell, *values in rows:
        out[:, cell] = values
    return out.reshape(3, *shape)


def fit(
    rows: DataFrame, group: str, key: str, features: str, label: str, trees: int = 20, depth: int = 3, bins: int = 64, rate: float = 0.1,
    l2: float = 1.0, least: int = 5, limit: int = 10_000,
) -> Ranker:
    """A ranker of the rows within their groups by grades from 0 to 30.

    Rows with a null group, key, features or label are left out; labels below 0 count as 0, above 30 as 30. Features
    have the length of the longest array; null, NaN and lacking elements are missing, which is a bin of its own. A group of more
    than ``limit`` rows is dealt into lists of about that many by the keys' hashes, all of which are learned from; rows of
    one key stay together. Without rows, or where no split gains, there are no trees and all scores are 0. ``bins``,
    255 at most, come from a mergeable sketch of quantiles.
    """
    if not 2 <= bins <= 255:
        raise ValueError("bins must be from 2 to 255")
    grade = F.least(F.greatest(F.col(label).cast("int"), F.lit(0)), F.lit(30)).cast("tinyint")
    own = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(features).cast("array<double>").alias("x"), grade.alias("y")).dropna()
    size = own.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return Ranker([])
    shares = [k / bins for k in range(1, bins)]
    sketch = [F.percentile_approx(F.nullif(F.get("x", F.lit(f)), F.lit(float("nan"))), shares, 10_000) for f in range(size)]
    ranker = Ranker([sorted(set(v or ())) for v in own.agg(*[c.alias(f"q{f}") for f, c in enumerate(sketch)]).first()])  # bins x features
    width = 1 + max(len(e) for e in ranker.edges) + 1
    base, kept, tree = rounds.cut(_packed(_lists(own, size, limit), ranker)), None, None
    for number in range(trees):
        state = base.mapInArrow(_advance(size, tree), _STATE)
        if number and number % CHUNK == 0:
            state = rounds.cut(state)
        state = state.persist()
        tree = Tree([-1] * ((1 << depth) - 1), [0] * ((1 << depth) - 1), [0.0] * (1 << depth))
        for level in range(depth):
            cells = _cells(state, size, width, tree, level)
            for node in range(1 << level):
                g, h, n = cells[:, node]
                if not n.any():
                    continue
                f, b = best_split(g, h, n, l2, least)
                heap = node + (1 << level) - 1
                tree.feature[heap], tree.bin[heap] = f, b
                left = np.ones(width, bool) if f < 0 else np.arange(width) <= b
                under = 1 << (depth - level - 1)  # leaves of a child
                for side, mask in enumerate((left, ~left)):
                    value = -rate * g[max(f, 0)][mask].sum() / SCALE / (h[max(f, 0)][mask].sum() / SCALE + l2)
                    tree.value[(2 * node + side) * under : (2 * node + side + 1) * under] = [float(value)] * under
        if kept is not None:
            kept.unpersist()
        base = kept = state
        if all(f < 0 for f in tree.feature):
            break
        ranker.trees.append(tree)
    if kept is not None:
        kept.unpersist()
    return ranker
