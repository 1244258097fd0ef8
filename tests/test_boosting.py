"""Boosted ranking trees against a plain version that holds all rows, and on held-out groups."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.operators import boosting
from plumeria.plans.catalog import QUERIES

FIELDS = "g long, k long, x array<double>, y int"


def plain_gradients(y, s):
    n = len(y)
    order = sorted(range(n), key=lambda i: (-s[i], i))
    d = {i: 1 / math.log2(2 + r) for r, i in enumerate(order)}
    pairs = [(i, j, (2.0 ** y[i] - 2.0 ** y[j]) * abs(d[i] - d[j])) for i in range(n) for j in range(n) if y[i] > y[j]]
    total, g, h = sum(w for *_, w in pairs), [0.0] * n, [0.0] * n
    for i, j, w in pairs:
        p = 1 / (1 + math.exp(s[i] - s[j]))
        g[i] -= w * p / total
        g[j] += w * p / total
        h[i] += w * p * (1 - p) / total
        h[j] += w * p * (1 - p) / total
    return np.array(g), np.array(h)


@pytest.mark.parametrize("block", [2, 256])
def test_gradients(block):
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        y, s = rng.integers(0, 4, n), rng.choice([0.0, 0.5, -1.0, 2.0], n)
        g, h = boosting.gradients(y.astype(float), s, block)
        want = plain_gradients(y, s)
        assert np.abs(g / boosting.SCALE - want[0]).max() < 1e-6 and np.abs(h / boosting.SCALE - want[1]).max() < 1e-6
    assert not boosting.gradients(np.ones(4), np.zeros(4))[0].any()


def plain_first_tree(groups, ranker, depth, l2, least, rate):
    """The first tree, recursively, from rows and thresholds instead of cells."""
    rows = []
    for members in groups:
        x, y = np.array([m[0] for m in members]), np.array([m[1] for m in members], float)
        g, h = boosting.gradients(y, np.zeros(len(y)))
        rows += list(zip(ranker.bins(x).astype(int).tolist(), g.tolist(), h.tolist(), strict=True))
    worth = lambda part: (sum(r[1] for r in part) / boosting.SCALE) ** 2 / (sum(r[2] for r in part) / boosting.SCALE + l2)
    leaf = lambda part: -rate * sum(r[1] for r in part) / boosting.SCALE / (sum(r[2] for r in part) / boosting.SCALE + l2)

    def grow(part, level):
        if level == depth:
            return leaf(part)
        best = (1e-12, None)
        for f in range(len(ranker.edges)):
            for b in range(len(ranker.edges[f]) + 2):
                left, right = [r for r in part if r[0][f] <= b], [r for r in part if r[0][f] > b]
                if min(len(left), len(right)) >= least and (gain := worth(left) + worth(right) - worth(part)) > best[0] + 1e-15:
                    best = (gain, (f, b, left, right))
        if best[1] is None:
            return leaf(part)
        f, b, left, right = best[1]
        return f, b, grow(left, level + 1), grow(right, level + 1)

    def value(tree, bins):
        while isinstance(tree, tuple):
            tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
        return tree

    return grow(rows, 0), value


def made(rng, groups, wide=3):
    rows = []
    for g in range(groups):
        for k in range(int(rng.integers(1, 9))):
            x = rng.normal(0, 1, wide)
            y = int(np.clip(round(1 + 1.5 * (x[0] > 0.3) - (x[1] > 0) + rng.normal(0, 0.3)), 0, 3))
            rows.append((g, 1000 * g + k, [None if rng.random() < 0.1 else float(v) for v in x], y))
    return rows


def test_first_tree_equals_plain(spark):
    rows = made(np.random.default_rng(2), 40)
    ranker = boosting.fit(spark.createDataFrame(rows, FIELDS).repartition(5), "g", "k", "x", "y", trees=1, bins=8)
    order = {r.k: r.h for r in spark.createDataFrame(rows, FIELDS).selectExpr("k", "xxhash64(1, k) AS h").collect()}
    groups = {}
    for g, k, x, y in sorted(rows, key=lambda r: order[r[1]]):
        groups.setdefault(g, []).append(([math.nan if v is None else v for v in x], y))
    tree, value = plain_first_tree(groups.values(), ranker, 3, 1.0, 5, 0.1)
    x = np.array([[math.nan if v is None else v for v in r[2]] for r in rows])
    want = [value(tree, b) for b in ranker.bins(x).astype(int).tolist()]
    assert len(set(want)) > 4
    assert np.abs(ranker.scores(x) - want).max() < 1e-9


def ndcg(rows, score):
    groups, out = {}, []
    for r, s in zip(rows, score, strict=True):
        groups.setdefault(r[0], []).append((s, r[3]))
    for members in groups.values():
        dcg = lambda ys: sum((2.0**y - 1) / math.log2(2 + i) for i, y in enumerate(ys))
        best = dcg(sorted((y for _, y in members), reverse=True))
        if best:
            out.append(dcg([y for _, y in sorted(members, key=lambda m: -m[0])]) / best)
    return sum(out) / len(out)


def test_held_out_groups_and_reruns(spark):
    """Better on groups not learned from than the best single column; any partitions give the same trees."""
    rng = np.random.default_rng(3)
    rows, held = made(rng, 150), made(rng, 80)
    frame = spark.createDataFrame(rows, FIELDS)
    ranker = boosting.fit(frame, "g", "k", "x", "y", trees=10, bins=16)
    again = boosting.fit(frame.repartition(7, "k"), "g", "k", "x", "y", trees=10, bins=16)
    assert len(ranker.trees) == 10 and ranker == again
    found = {r.k: r.s for r in spark.createDataFrame(held, FIELDS).select("k", ranker.score(F.col("x")).alias("s")).collect()}
    x = np.array([[math.nan if v is None else v for v in r[2]] for r in held])
    assert np.abs(np.array([found[r[1]] for r in held]) - ranker.scores(x)).max() < 1e-12
    single = ndcg(held, np.nan_to_num(x[:, 0]))
    assert ndcg(held, [found[r[1]] for r in held]) > single + 0.02


def test_hot_group_nulls_and_empty(spark):
    rng = np.random.default_rng(4)
    rows = [(0, k, [float(v) for v in rng.normal(0, 1, 2)], 0) for k in range(600)]
    rows = [(g, k, x, int(x[0] > 0)) for g, k, x, _ in rows]
    spoilt = [(None, 1, [9.0, 9.0], 1), (1, None, [9.0, 9.0], 1), (1, 1, None, 1), (1, 1, [9.0, 9.0], None), (2, 2, [], 9), (2, 3, [math.nan, 1.0], -4)]
    frame = spark.createDataFrame(rows + spoilt, FIELDS).withColumns({"n": F.lit("other"), "part": F.lit("other"), "of": F.lit("other")})
    lists = boosting._lists(frame.selectExpr("g", "k", "x", "cast(y as tinyint) y").dropna(), 2, 100).selectExpr("size(y) n").collect()
    assert sum(r.n for r in lists) == 602 and max(r.n for r in lists) < 200 and len(lists) >= 7
    ranker = boosting.fit(frame, "g", "k", "x", "y", trees=3, bins=16, limit=100)
    x = np.array([r[2] for r in rows])
    score = ranker.scores(x)
    assert score[x[:, 0] > 0.2].min() > score[x[:, 0] < -0.2].max()
    shown = spark.createDataFrame([(1, [1.0]), (2, None), (3, [1.0, math.nan, 5.0])], "k long, x array<double>").select("k", ranker.score(F.col("x")).alias("s")).collect()
    assert [r.s is None for r in shown] == [False, True, False]
    assert boosting.fit(frame.where("false"), "g", "k", "x", "y") == boosting.Ranker([])
    flat = spark.createDataFrame([(1, 1, [1.0], 0), (1, 2, [1.0], 1)], FIELDS)
    assert boosting.fit(flat, "g", "k", "x", "y").trees == []


def test_query(spark):
    found = QUERIES["boosted_ranking"](spark, "/root/testdata/sf0.001").collect()
    assert found and len(found) == len({(r.req, r.item) for r in found})
    for r in found:
        assert r.place == 1 + sum(o.req == r.req and (-o.score, o.item) < (-r.score, r.item) for o in found)
