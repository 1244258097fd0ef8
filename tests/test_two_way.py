"""Two-way splits against a plain version that takes one cluster after the other."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from plumeria.functions.fuzzy import greedy_jaccard
from plumeria.operators import two_way
from plumeria.plans.catalog import QUERIES

SCHEMA = "cluster long, id long, vec array<double>, title string, side string, n int"


def draw(which, start, i):
    return (int(hashlib.md5(f"{two_way.SEED}:{which}:{start}:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def best_sides(ids, x):
    """By start: two drawn points, then nearest means until nothing moves."""
    best = None
    for start in range(two_way.STARTS):
        a = x[min(range(len(ids)), key=lambda k: (draw(0, start, ids[k]), ids[k]))]
        d = ((x - a) ** 2).sum(axis=1)
        if not d.any():
            return None
        b = x[min((k for k in range(len(ids)) if d[k] > 0), key=lambda k: (-math.log(draw(1, start, ids[k])) / d[k], ids[k]))]
        sides = None
        while True:
            now = ((x - a) ** 2).sum(axis=1) > ((x - b) ** 2).sum(axis=1)
            if sides is not None and (now == sides).all():
                break
            sides = now
            a, b = x[~sides].mean(axis=0), x[sides].mean(axis=0)
        within = sum(((x[s] - x[s].mean(axis=0)) ** 2).sum() for s in (sides, ~sides))
        if best is None or within < best[0] - 1e-9:
            best = within, sides
    return best[1] != best[1][np.argmin(ids)]


def mean_distance(x):
    return 0.0 if len(x) < 2 else np.mean([np.linalg.norm(x[i] - x[j]) for i in range(len(x)) for j in range(i)])


def silhouette(x, s):
    if min(s.sum(), (~s).sum()) < 2:
        return -1.0
    total = 0.0
    for k in range(len(x)):
        d = np.linalg.norm(x - x[k], axis=1)
        mine = s == s[k]
        a, b = d[mine].sum() / (mine.sum() - 1), d[~mine].mean()
        total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(x)


def names(titles):
    counts = Counter(w for t in titles for w in set(re.findall("[가-힣A-Za-z0-9]{2,}", t)) - set(two_way.STOPWORDS))
    return sorted(counts, key=lambda w: (-counts[w], -len(w), w))[:8]


def decide(ids, x, titles):
    n = len(ids)
    if n <= 2:
        return {"reason": "small"}, None
    if n == 3:
        d = np.linalg.norm(x - x.mean(axis=0), axis=1)
        if (x == x[0]).all():
            return {"reason": "equal"}, None
        far = max(range(3), key=lambda k: (round(d[k], 9), ids[k]))
        s = np.array([(k == far) != (ids[far] == min(ids)) for k in range(3)])
        low = sorted(d)
    else:
        s = best_sides(ids, x)
        if s is None:
            return {"reason": "equal"}, None
    one, two = names([t for t, k in zip(titles, s, strict=True) if not k]), names([t for t, k in zip(titles, s, strict=True) if k])
    out = {"n0": int((~s).sum()), "n1": int(s.sum()), "all_intra": mean_distance(x), "intra0": mean_distance(x[~s]), "intra1": mean_distance(x[s])}
    out["centroid_dist"] = np.linalg.norm(x[s].mean(axis=0) - x[~s].mean(axis=0))
    ratio = out["dist_ratio"] = out["centroid_dist"] / (out["all_intra"] + 1e-6)
    sil = out["silhouette"] = silhouette(x, s)
    normal = Counter(k for t in titles if (k := re.sub(two_way.MARKS, "", re.sub(two_way.ASIDE, " ", t.lower()))))
    dup = out["dup_ratio"] = max(normal.values()) / sum(normal.values()) if normal else 0.0
    if n == 3:
        p, q = ({w[i : i + 2] for w in k for i in range(len(w) - 1)} for k in (one, two))
        jac = out["names_jaccard"] = len(p & q) / len(p | q) if p | q else 1.0
        strong = (low[2] / (low[1] + 1e-9) if low[1] > 1e-9 else 999) >= 1.35 and low[2] - low[1] >= 0.2
        return out | {"reason": "outlier" if strong and (jac <= 0.18 or ratio >= 1.2) else "three"}, s
    jac = out["names_jaccard"] = greedy_jaccard(one, two)
    score = 90 if ratio >= 1.2 else 45 if ratio >= 1.08 else 0
    score += 90 if sil >= 0.1 else 35 if sil >= 0.07 else 0
    score += 80 if jac <= 0.15 else 35 if jac <= 0.35 else 0
    if out["all_intra"] > 1e-6:
        worst = max(out["intra0"], out["intra1"]) / out["all_intra"]
        score += 70 if worst <= 0.75 else 25 if worst <= 0.9 else 0
    if n >= 6 and min(out["n0"], out["n1"]) / max(out["n0"], out["n1"]) < 0.2:
        score -= 40
    out["score"] = score
    if jac >= 0.55:
        return out | {"reason": "veto_names"}, s
    if dup >= 0.5:
        return out | {"reason": "veto_titles"}, s
    if n >= 5 and jac <= 0.12 and sil >= 0.18:
        return out | {"reason": "force"}, s
    return out | {"reason": "score" if score >= 180 else "held"}, s


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(8)
    words = [["bank", "rates", "mortgage", "이번", "inflation"], ["storm", "flood", "rescue", "rain", "x"], ["rates", "banks", "storms"]]
    out = {}
    for c in range(44):
        n = [1, 2, 3, 3, 3, 4, 5, 6, 9, 14, 70][c % 11]
        far = rng.choice([0.0, 0.6, 1.5, 4.0])
        topic = rng.random(n) < (0.12 if c % 5 == 1 else 0.5)
        x = rng.normal(0, 0.4, (n, 4)) + far * topic[:, None]
        own = [words[1 if t and c % 3 else 0] + (words[2] if c % 4 == 0 else []) for t in topic]
        titles = [" ".join(rng.choice(w, min(len(w), 3), replace=False)) for w in own]
        if c % 7 == 3:
            titles = ["[Photo] Same - title!" if rng.random() < 0.8 else t for t in titles]
        if c in (16, 13):
            x[:] = x[0]
        if c == 17:
            x = np.round(x)  # many equal points
            titles = [""] * n
        out[c] = (rng.permutation(n + 5)[:n].tolist(), np.rint(x * two_way.PARTS) / two_way.PARTS, titles)
    return out


@pytest.mark.parametrize("block", [two_way.BLOCK, 9])
def test_decisions(spark, clusters, block):
    rows = [(c, i, v, t, "extra", 7) for c, (ids, x, titles) in clusters.items() for i, v, t in zip(ids, x.tolist(), titles, strict=True)]
    greater = [(c, i, [k + 1 for k in v], t, s, n) for c, i, v, t, s, n in rows[:5]]
    unusable = [(None, 1, [0.0] * 4, "a", None, None), (0, None, [0.0] * 4, "a", None, None), (0, 99, None, "a", None, None)]
    frame = spark.createDataFrame(rows + rows[:9] + greater + unusable, SCHEMA).repartition(7)
    found, members = two_way.split_decisions(frame, 4, block=block)
    got, parts = {r.cluster: r for r in found.collect()}, {(r.cluster, r.id): r.side for r in members.collect()}
    assert len(got) == len(clusters) and len(parts) == sum(len(ids) for ids, _, _ in clusters.values())
    reasons = Counter()
    for c, (ids, x, titles) in clusters.items():
        want, s = decide(ids, x, titles)
        reasons[want["reason"]] += 1
        assert [parts[c, i] for i in ids] == ([None] * len(ids) if s is None else s.astype(int).tolist()), c
        r = got[c].asDict()
        assert r["n"] == len(ids) and r["reason"] == want["reason"] and r["split"] == (want["reason"] in ("outlier", "force", "score")), (c, r, want)
        for k in ("n0", "n1", "score"):
            assert r[k] == want.get(k), (c, k)
        for k in ("all_intra", "intra0", "intra1", "centroid_dist", "dist_ratio", "silhouette", "names_jaccard", "dup_ratio"):
            assert r[k] == pytest.approx(want[k], abs=1e-6) if k in want else r[k] is None, (c, k)
    assert set(reasons) >= {"small", "equal", "outlier", "three", "veto_names", "veto_titles", "force", "score", "held"}, reasons


def test_missing_titles_and_elements(spark):
    rows = [(1, k, [float(k // 2)] if k else [], None, None, None) for k in range(4)]
    found, members = two_way.split_decisions(spark.createDataFrame(rows, SCHEMA), 2)
    assert [(r.reason, r.dup_ratio, r.names_jaccard) for r in found.collect()] == [("veto_names", 0.0, 1.0)]
    assert {r.id: r.side for r in members.collect()} == {0: 0, 1: 0, 2: 1, 3: 1}


def test_empty_table(spark):
    found, members = two_way.split_decisions(spark.createDataFrame([], SCHEMA), 2)
    assert found.collect() == [] and members.collect() == []


def test_query(spark):
    found = QUERIES["topic_splits"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n for r in found) == 500 and all((r.n0 or 0) + (r.n1 or 0) in (0, r.n) for r in found)
