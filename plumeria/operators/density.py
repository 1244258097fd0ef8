"""Density clustering of vectors, batch by batch, all batches at once.

The nearest neighbours of every point are found exactly, in blocks of its batch. A point's core distance is that to its
``samples``-th neighbour; the length of an edge between neighbours is the largest of their distance and both core
distances. Borůvka's rounds over the table of edges give the least spanning forest: every part takes its shortest edge
out, parts that are so joined become one, and the edges are renamed; a round at least halves the parts. The forest of a
batch, two ids and a length for each point, is then read from its longest edge down into the tree of clusters, and the
clusters with the largest excess of mass are taken. Edges of one length are cut together, so the result doesn't depend
on which of them the forest holds. Parts of the neighbour graph without an edge between them are joined at infinity.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeria.operators.rounds import cut

NEIGHBOURS, SAMPLES, SMALLEST = 16, 2, 3
#: Points of a block, and the least length of an edge.
BLOCK, LEAST = 512, 1e-9


def nearest(points: DataFrame, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(batch, a, b, d, place): the exact nearest other points of each point (batch, id, vec) of its batch, by (d, b).

    A batch is dealt into blocks by a hash of the id, and every block meets every other in a task, which gives only the
    nearest of each point. A point's vector is so sent to twice as many tasks as its batch has blocks.
    """
    sizes = points.groupBy("batch").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = points.join(sizes, "batch").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("batch", F.col("own").alias("i"), other.alias("j"), "id", "vec")
    right = dealt.select(F.col("batch").alias("batch"), other.alias("i"), F.col("own").alias("j"), F.col("id").alias("id"), F.col("vec").alias("vec"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"batch": [], "a": [], "b": [], "d": []})
        x, y, ids, others = np.stack(a["vec"]).astype(float), np.stack(b["vec"]).astype(float), a["id"].to_numpy(), b["id"].to_numpy()
        step, out = max(1, (1 << 22) // y.size), []
        for at in range(0, len(x), step):
            d = np.sqrt(((x[at : at + step, None] - y[None]) ** 2).sum(axis=2))
            d[ids[at : at + step, None] == others[None]] = np.inf
            order = np.lexsort((np.broadcast_to(others, d.shape), d), axis=1)[:, :neighbours]
            out.append(pd.DataFrame({"a": np.repeat(ids[at : at + step], order.shape[1]), "b": others[order].ravel(), "d": np.take_along_axis(d, order, 1).ravel()}))
        found = pd.concat(out)
        return found[np.isfinite(found["d"])].assign(batch=a["batch"].iloc[0])[["batch", "a", "b", "d"]]

    met = left.groupBy("batch", "i", "j").cogroup(right.groupBy("batch", "i", "j")).applyInPandas(best, "batch long, a long, b long, d double")
    place = F.row_number().over(Window.partitionBy("batch", "a").orderBy("d", "b"))
    return met.withColumn("place", place).where(F.col("place") <= neighbours)


def reachability(near: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(batch, a, b, w) with a < b: the neighbour graph by mutual reachability."""
    core = near.where(F.col("place") <= samples).groupBy("batch", "a").agg(F.max("d").alias("core"))
    both = near.join(core, ["batch", "a"]).join(core.select("batch", F.col("a").alias("b"), F.col("core").alias("other")), ["batch", "b"])
    w = F.greatest("d", "core", "other", F.lit(LEAST))
    return both.select("batch", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), w.alias("w")).groupBy("batch", "a", "b").agg(F.min("w").alias("w"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, int]:
    """((batch, a, b, w) of the least spanning forest, rounds). Ties go by (w, a, b), so no circle closes."""
    left = cut(edges.select("batch", F.col("a").alias("p"), F.col("b").alias("q"), F.struct("w", "a", "b").alias("e")))
    taken: DataFrame | None = None
    rounds = 0
    while not left.isEmpty():
        rounds += 1
        ways = left.select("batch", "p", F.struct("e", F.col("q").alias("to")).alias("way")).unionByName(left.select("batch", F.col("q").alias("p"), F.struct("e", F.col("p").alias("to")).alias("way")))
        best = cut(ways.groupBy("batch", "p").agg(F.min("way").alias("way")))
        fresh = best.select("batch", "way.e.a", "way.e.b", "way.e.w").distinct()
        taken = fresh if taken is None else taken.unionByName(fresh)
        # Two parts that choose one edge point at each other: the smaller id is the root.
        back = best.select("batch", F.col("p").alias("to"), F.col("way.to").alias("back"))
        up = best.select("batch", "p", F.col("way.to").alias("to")).join(back, ["batch", "to"])
        up = up.select("batch", "p", F.when((F.col("back") == F.col("p")) & (F.col("p") < F.col("to")), F.col("p")).otherwise(F.col("to")).alias("root"))
        up = cut(up)
        while True:
            further = cut(up.join(up.select("batch", F.col("p").alias("root"), F.col("root").alias("next")), ["batch", "root"]).select("batch", "p", F.col("next").alias("root")))
            moved = not further.exceptAll(up).isEmpty()
            up = further
            if not moved:
                break
        one = left.join(up.withColumnRenamed("root", "x"), ["batch", "p"]).join(up.select("batch", F.col("p").alias("q"), F.col("root").alias("y")), ["batch", "q"])
        one = one.where("x <> y").select("batch", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "e")
        left = cut(one.groupBy("batch", "p", "q").agg(F.min("e").alias("e")))
    if taken is None:
        taken = edges.where("false")
    return cut(taken.select("batch", "a", "b", "w")), rounds


def _tree(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[list[list[int]], list[float], list[int]]:
    """(children, length, size) of the nodes of the cluster tree; the first ones are the points, the last the root."""
    number = {x: k for k, x in enumerate(ids.tolist())}
    children: list[list[int]] = [[] for _ in number]
    length, size = [0.0] * len(number), [1] * len(number)
    above = list(range(len(number)))  # by point: a point of its part
    node = list(range(len(number)))  # by first point of a part: its node

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def merged(pairs: list[tuple[int, int]], at: float) -> None:
        parts = {r for x, y in pairs for r in (find(x), find(y))}
        held = {r: node[r] for r in parts}
        for x, y in pairs:
            above[find(x)] = find(y)
        groups: dict[int, list[int]] = {}
        for r in sorted(parts):
            groups.setdefault(find(r), []).append(held[r])
        for root, own in groups.items():
            node[root] = len(children)
            children.append(own)
            length.append(at)
            size.append(sum(size[k] for k in own))

    order = np.argsort(w, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(w[order])) + 1):
        if len(run):
            merged([(number[x], number[y]) for x, y in zip(a[run].tolist(), b[run].tolist(), strict=True)], float(w[run[0]]))
    roots = sorted({find(k) for k in range(len(number))})
    if len(roots) > 1:
        merged([(roots[0], r) for r in roots[1:]], math.inf)
    return children, length, size


def cluster_labels(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, smallest: int = SMALLEST) -> dict[int, tuple[int, float]]:
    """{id: (least id of its cluster, stability of the cluster)} from a batch's spanning forest; noise has no entry."""
    if len(ids) < smallest:
        return {}
    children, length, size = _tree(ids, a, b, w)
    clusters: list[dict] = []  # parents come before children
    stack = [(len(children) - 1, 0.0, -1)]
    while stack:
        node, birth, parent = stack.pop()
        me = len(clusters)
        clusters.append({"node": node, "parent": parent, "stability": 0.0, "below": 0.0, "chosen": True})
        while True:
            if not children[node]:
                break
            fade = 1.0 / length[node]  # 0 at infinity
            large = [k for k in children[node] if size[k] >= smallest]
            gone = size[node] if len(large) != 1 else size[node] - size[large[0]]
            clusters[me]["stability"] += (fade - birth) * gone
            if len(large) == 1:
                node = large[0]
                continue
            stack += [(k, fade, me) for k in large]
            clusters[me]["leaf"] = not large
            break
    for me in range(len(clusters) - 1, -1, -1):
        c = clusters[me]
        if not c.get("leaf", True) and c["below"] > c["stability"] or me == 0:
            c["chosen"] = False
        if c["parent"] >= 0:
            clusters[c["parent"]]["below"] += c["stability"] if c["chosen"] else c["below"]
    out: dict[int, tuple[int, float]] = {}
    covered = [False] * len(clusters)
    for me, c in enumerate(clusters):
        covered[me] = c["parent"] >= 0 and (covered[c["parent"]] or clusters[c["parent"]]["chosen"])
        if c["chosen"] and not covered[me]:
            points, todo = [], [c["node"]]
            while todo:
                k = todo.pop()
                if children[k]:
                    todo += children[k]
                else:
                    points.append(int(ids[k]))
            out |= dict.fromkeys(points, (min(points), c["stability"]))
    return out


def clusters(points: DataFrame, neighbours: int = NEIGHBOURS, samples: int = SAMPLES, smallest: int = SMALLEST, block: int = BLOCK) -> DataFrame:
    """(batch, id, cluster, stability) for each point (batch, id, vec): the least id of its cluster, null for noise.

    ``neighbours`` is at least ``samples``; with as many as a batch has points the graph is whole. The whole batch is
    never a cluster. Points without batch, id or vector are left out; points that share batch and id are one, with the
    least vector. A batch of fewer than ``smallest`` points is noise, an empty table gives an empty result. A task
    holds the forest of one batch, 24 bytes a point; its vectors it never sees.
    """
    if neighbours < samples or samples < 1 or smallest < 2:
        raise ValueError("neighbours >= samples >= 1 and smallest >= 2")
    good = points.where("batch IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL")
    good = cut(good.groupBy(F.col("batch").cast("long").alias("batch"), F.col("id").cast("long").alias("id")).agg(F.min(F.col("vec").cast("array<double>")).alias("vec")))
    forest, _ = spanning_forest(reachability(cut(nearest(good, neighbours, block)), samples))

    def label(ids: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(ids["id"].to_numpy())
        found = cluster_labels(own, edges["a"].to_numpy(np.int64), edges["b"].to_numpy(np.int64), edges["w"].to_numpy(float), smallest) if len(own) else {}
        rows = [(ids["batch"].iloc[0], x, *found.get(x, (None, None))) for x in own.tolist()]
        return pd.DataFrame(rows, columns=["batch", "id", "cluster", "stability"]).astype({"cluster": "Int64", "stability": "Float64"})

    return good.select("batch", "id").groupBy("batch").cogroup(forest.groupBy("batch")).applyInPandas(label, "batch long, id long, cluster long, stability double")
