"""The request feature matrix against a plain loop over all events, and what is fitted on it."""

from __future__ import annotations

import math
import random

import numpy as np

import pytest

from plumeria.operators import feature_matrix as matrix
from plumeria.operators import pairwise
from plumeria.plans.catalog import QUERIES
from plumeria.plans.matrix import TERMS, design_rows

HOUR, DAY = 3600, 86400
T0 = 1_704_067_200


def plain_matrix(requests, clicks, views, catalogue, static, extras, s=matrix.Settings()):
    cat = {i: (np.array(e) / (np.linalg.norm(e) or 1), c, p) for i, e, c, p in catalogue}
    out = {}
    for req, user, t, items in requests:
        past = sorted((x for x in clicks if x[0] == user and user is not None and x[1] in cat and x[2] is not None and x[2] < t), key=lambda x: x[2])
        hist = sum((2.0 ** (-(t - x[2]) / s.half_life_s) * cat[x[1]][0] for x in past), np.zeros(3))
        short = [x for x in past if x[2] >= t - s.short_s]
        sess = []
        if past and t - past[-1][2] <= s.gap_s:
            for x in reversed(past):
                if sess and sess[-1][2] - x[2] > s.gap_s:
                    break
                sess.append(x)
        cos = lambda v, e: float(v @ e / np.linalg.norm(v)) if np.linalg.norm(v) > 0 else 0.0
        chosen = {c for u, c in static if u == user and c is not None}
        age, gender = extras.get(user, (None, None))
        for item in {x for x in items or () if x in cat}:
            e, c, pub = cat[item]
            n = lambda rows, w, item=item, t=t: sum(1 for *_, i, at in rows if i == item and at is not None and t - w <= at < t)
            hours = max(0.0, (t - pub) / HOUR)
            six, day, two = (n(clicks, w) for w in s.windows_s)
            seen = n(views, s.ctr_s)
            out[req, item] = [
                hours, hours <= 24, hours <= 168, cos(hist, e), c in chosen, c in chosen, c, age, gender, len(chosen), six, day, two, seen, n(clicks, s.ctr_s) / max(seen, 1),
                cos(sum((cat[x[1]][0] for x in short), np.zeros(3)), e), len(short), cos(sum((cat[x[1]][0] for x in sess), np.zeros(3)), e), len(sess),
                (t - past[-1][2]) / HOUR if past else None, sum(cat[x[1]][1] == c for x in past) / max(len(past), 1), len(past),
            ]
    return out


def test_matrix(spark):
    rng = random.Random(4)
    catalogue = [(i, [rng.gauss(0, 1) for _ in range(3)] if i != 5 else [0.0] * 3, i % 4, T0 + rng.randint(-20, 20) * DAY) for i in range(30)]
    clicks = [(0 if rng.random() < 0.4 else rng.randrange(9), rng.randrange(33), T0 + rng.choice([rng.randint(0, 9 * DAY), rng.randint(0, 40) * 900])) for _ in range(500)]
    # A session over midnight, one that pauses by exactly the gap, one far back; equal seconds.
    clicks += [(20, 1, T0 + DAY - 100), (20, 2, T0 + DAY + 100), (20, 3, T0 + DAY + 1900), (20, 4, T0 + DAY + 3701), (21, 7, T0), (22, 7, T0 + 5), (22, 8, T0 + 5)]
    clicks += [(23, k % 30, T0 + 1000 * k) for k in range(200)] + [(None, 1, T0), (3, None, T0), (4, 1, None)]
    views = [(rng.randrange(33), T0 + rng.randint(0, 9 * DAY)) for _ in range(600)] + [(None, T0), (3, None)]
    requests = [(i, rng.choice([*range(12), 0, 0, 20, 20, 23]), T0 + rng.randint(0, 10 * DAY), rng.sample(range(35), 4) + [2, 2]) for i in range(120)]
    requests += [(200, 20, T0 + DAY + 200, [1, 2]), (201, 20, T0 + DAY + 3700, [1]), (202, 20, T0 + DAY + 3702, [1]), (203, 21, T0 + 8 * DAY, [7, 9]), (204, 22, T0 + 5, [7]), (205, 22, T0 + 6, [7])]
    requests += [(206, None, T0 + DAY, [1]), (207, 23, T0 + 1000 * 199 + 1, [3]), (208, 1, T0 + DAY, []), (209, 1, T0 + DAY, None)]
    static = [(u, c) for u in range(0, 9, 2) for c in range(u % 4)] + [(2, None), (0, 1)]
    extras = {u: (20 + u, u % 2) for u in range(5)} | {6: (None, 1)}
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    found = matrix.feature_matrix(
        frame(requests, "req long, user_id long, t long, items array<long>"), frame(clicks, "user_id long, item long, s long"), frame(views, "item long, s long"),
        frame(catalogue, "item long, emb array<float>, category int, pub_s long"), frame(static, "user_id long, category int"),
        frame([(u, *x) for u, x in extras.items()], "user_id long, user_age int, user_gender int"),
    )
    assert found.columns == ["req", "item", *matrix.COLUMNS] and {t for _, t in found.dtypes[2:]} == {"float"}
    want = plain_matrix(requests, clicks, [(None, *v) for v in views], catalogue, static, extras)
    got = {(r.req, r.item): list(r[2:]) for r in found.collect()}
    assert got.keys() == want.keys() and len(got) > 300
    for key, row in want.items():
        for name, a, b in zip(matrix.COLUMNS, got[key], row, strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, float(b), rel_tol=1e-5, abs_tol=1e-5)), (key, name, a, b)


def test_matrix_of_empty_tables(spark):
    frame = lambda ddl: spark.createDataFrame([], ddl)
    found = matrix.feature_matrix(
        frame("req long, user_id long, t long, items array<long>"), frame("user_id long, item long, s long"), frame("item long, s long"),
        frame("item long, emb array<float>, category int, pub_s long"), frame("user_id long, category int"), frame("user_id long, user_age int, user_gender int"),
    )
    assert found.collect() == []


# The pairwise fit


def plain_fit(rows, l2):
    groups = {}
    for g, x, y in rows:
        groups.setdefault(g, ([], []))[bool(y)].append(np.array(x))
    d, a = [], []
    for negative, positive in groups.values():
        pairs = [p - n for p in positive for n in negative]
        d += pairs
        a += [1 / max(len(pairs), 1)] * len(pairs)
    d, a = np.array(d), np.array(a) / sum(1 for n, p in groups.values() if n and p)
    w = np.zeros(d.shape[1])
    for _ in range(60):
        s = 1 / (1 + np.exp(d @ w))
        w = w - np.linalg.solve((d.T * (a * s * (1 - s))) @ d + l2 * np.eye(len(w)), -(d.T @ (a * s)) + l2 * w)
    return w, len(d)


@pytest.mark.parametrize("block", [pairwise.BLOCK, 7])
def test_pairwise_fit(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(60):
        n = 700 if g == 0 else int(rng.integers(1, 9))
        for _ in range(n):
            x = rng.normal(0, 1, 3)
            rows.append((g, x.tolist(), int(rng.random() < 1 / (1 + np.exp(-(2 * x[0] - x[1]))))))
    rows += [(100, [1.0, 2.0, 3.0], 1), (101, [1.0, 2.0, 3.0], 0)]
    frame = spark.createDataFrame([*rows, (None, [9.0] * 3, 1), (5, None, 0), (5, [9.0] * 3, None)], '"group" long, x array<double>, y int'.replace('"', ""))
    fit = pairwise.fit(frame.withColumnsRenamed({"group": "g"}), "g", "x", "y", l2=1e-3, block=block)
    w, n = plain_fit([(g, x, y) for g, x, y in rows], 1e-3)
    assert fit.converged and fit.pairs == n and np.abs(np.array(fit.weights) - w).max() < 1e-6
    assert fit.weights[0] > 1 > -0.5 > fit.weights[1]


def test_pairwise_fit_far_from_its_start(spark):
    """Differences of thousands: a whole Newton step overshoots, shorter ones are taken."""
    rng = np.random.default_rng(9)
    rows = [(g, [float(rng.normal(0, 3000)), float(rng.normal(0, 1))], k % 3 == 0) for g in range(40) for k in range(6)]
    rows = [(g, [x[0] + 4000 * y, x[1] + 0.5 * y], int(y)) for g, x, y in rows]
    fit = pairwise.fit(spark.createDataFrame(rows, "g long, x array<double>, y int"), "g", "x", "y", l2=1e-6)
    assert fit.converged and np.abs(np.array(fit.weights) - plain_fit(rows, 1e-6)[0]).max() < 1e-6


def test_pairwise_fit_without_pairs(spark):
    fit = pairwise.fit(spark.createDataFrame([(1, [1.0, 2.0], 1)], "g long, x array<double>, y int"), "g", "x", "y")
    assert fit == pairwise.Fit([], 0, 0, 0, False, None)


def test_pairwise_weights_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.req, r.x, r.label) for r in design_rows(spark, sf).collect()]
    w, n = plain_fit(rows, 1e-6)
    found = {r.term: r for r in QUERIES["pairwise_weights"](spark, sf).collect()}
    assert list(found) == list(TERMS)
    for k, term in enumerate(TERMS):
        assert abs(found[term].weight - w[k]) < 1e-5 and found[term].pairs == n and found[term].converged
