"""Density clusters against a plain version that looks for connected parts at every length anew."""

from __future__ import annotations

import numpy as np
import pytest

from plumeria.operators import density
from plumeria.plans.catalog import QUERIES


def plain_clusters(ids, vectors, samples, smallest):
    x = np.array(vectors, float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d + np.diag([np.inf] * len(x)), axis=1)[:, samples - 1]
    w = np.maximum(np.maximum(d, np.maximum(core[:, None], core[None])), density.LEAST)

    def parts(own, below):
        left, out = set(own), []
        while left:
            todo = [left.pop()]
            part = set(todo)
            while todo:
                k = todo.pop()
                near = {j for j in left if w[k, j] < below}
                left -= near
                part |= near
                todo += near
            out.append(part)
        return out

    def grow(own, birth):
        me = {"points": set(own), "stability": 0.0, "children": []}
        while len(own) > 1:
            lengths = sorted({w[i, j] for i in own for j in own if i != j})
            cut = next(t for k, t in enumerate(lengths) if k + 1 == len(lengths) or len(parts(own, lengths[k + 1])) == 1)
            split = parts(own, cut)
            large = [p for p in split if len(p) >= smallest]
            me["stability"] += (1 / cut - birth) * sum(len(p) for p in split if len(large) != 1 or p is not large[0])
            if len(large) != 1:
                me["children"] = [grow(p, 1 / cut) for p in large]
                break
            own = large[0]
        return me

    def chosen(c):
        below = [x for k in c["children"] for x in chosen(k)]
        return below if below and sum(x["stability"] for x in below) > c["stability"] else [c]

    root = grow(set(range(len(ids))), 0.0)
    found = [x for k in root["children"] for x in chosen(k)]
    return {ids[k]: min(ids[j] for j in c["points"]) for c in found for k in c["points"]}


def batch(rng, n, kind):
    if kind == 0:
        centres = rng.normal(0, 4, (4, 3))
        return centres[rng.integers(0, 4, n)] + rng.normal(0, rng.choice([0.2, 1.0]), (n, 3))
    if kind == 1:
        return rng.integers(0, 4, (n, 3)).astype(float)  # many equal distances and equal points
    return rng.normal(0, 1, (n, 3))


@pytest.mark.parametrize("block", [density.BLOCK, 7])
def test_clusters(spark, block):
    rng = np.random.default_rng(5)
    sizes = [40, 33, 25, 30, 2, 3, 1, 12]
    rows, want = [], {}
    for k, n in enumerate(sizes):
        ids = (1000 * (k % 2) + rng.permutation(n)).tolist()
        vectors = batch(rng, n, k % 3).round(6).tolist()
        rows += [(k, i, v) for i, v in zip(ids, vectors, strict=True)]
        found = plain_clusters(ids, vectors, 2, 3) if n > 2 else {}
        want |= {(k, i): found.get(i) for i in ids}
    extra = [rows[0], (None, 1, [0.0] * 3), (0, None, [0.0] * 3), (0, 2000, None)]
    frame = spark.createDataFrame(rows + extra, "batch long, id long, vec array<double>")
    got = {(r.batch, r.id): r.cluster for r in density.clusters(frame, neighbours=40, block=block).collect()}
    assert got == want
    assert len({x for x in want.items() if x[1] is not None}) > 60 and None in want.values()


def test_rounds_are_logarithmic_and_the_forest_least(spark):
    rng = np.random.default_rng(6)
    n = 300
    chain = [(0, k, k + 1, float(n - k)) for k in range(n - 1)]  # one part takes in all others
    loose = [(1, int(a), int(b), float(rng.integers(1, 9))) for a, b in {tuple(sorted(rng.choice(80, 2, False).tolist())) for _ in range(160)}]
    forest, rounds = density.spanning_forest(spark.createDataFrame(chain + loose, "batch long, a long, b long, w double"))
    found = [tuple(r) for r in forest.collect()]
    assert rounds <= 9 and sorted(x for x in found if x[0] == 0) == chain
    above = {k: k for k in range(80)}

    def find(x):
        return x if above[x] == x else find(above[x])

    want = []
    for e in sorted(loose, key=lambda e: (e[3], e[1], e[2])):
        if find(e[1]) != find(e[2]):
            above[find(e[1])] = find(e[2])
            want.append(e)
    assert sorted(x for x in found if x[0] == 1) == sorted(want)


def test_clusters_of_an_empty_table(spark):
    assert density.clusters(spark.createDataFrame([], "batch long, id long, vec array<float>")).collect() == []
    with pytest.raises(ValueError):
        density.clusters(spark.createDataFrame([], "batch long, id long, vec array<float>"), neighbours=1)


def test_clusters_query(spark):
    found = QUERIES["density_clusters"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.item for r in found}) == len(found) > 100
    for r in found:
        assert (r.cluster is None) == (r.size is None) and (r.size is None or r.size >= 3)
