"""Self-preference contrasts against numpy with the same draws, and rows that can't be judged."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from plumeria.operators import inference

FIELDS = "c long, g string, j string, f string, x double, y double"
NAMES = ("c", "g", "j", "f", "x", "y")


def weight(b, c):
    u = int(hashlib.md5(f"0:{b}:{c}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return sum(u >= p for p in inference.POISSON)


def plain(rows, reference, replicates):
    error = {}
    for j in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == j]
        z = lambda v: (np.array(v) - np.mean(v)) / np.std(v) if np.std(v) > 0 else np.zeros(len(v))
        error[j] = list(zip(z([r[4] for r in mine]) - z([r[5] for r in mine]), [r[1] for r in mine], [r[0] for r in mine], strict=True))

    def gap(j, family, b):
        mean = lambda keep: (sum(w * e for w, e in keep) / s if (s := sum(w for w, _ in keep)) else math.nan)
        w = [(weight(b, c) if b else 1, e, g) for e, g, c in error[j]]
        return mean([(k, e) for k, e, g in w if g == family]) - mean([(k, e) for k, e, g in w if g != family])

    out = {}
    for j in set(error) - {reference}:
        family = min(r[3] for r in rows if r[2] == j)
        if any(r[1] == family for r in rows if r[2] == j) and reference in error:
            draws = [d for b in range(1, replicates + 1) if not math.isnan(d := gap(j, family, b) - gap(reference, family, b))]
            own, ref = gap(j, family, 0), gap(reference, family, 0)
            out[j] = (family, len(error[j]), own, ref, own - ref, *np.quantile(draws, [0.025, 0.975]))
    return out


def test_contrast(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(25):
        for g in "abc":
            for j, f in (("A", "a"), ("B", "b"), ("R", "r"), ("S", "s")):
                for _ in range(int(rng.integers(1, 30 if c == 0 else 3))):
                    y = float(rng.normal(3, 1))
                    rows.append((c, g, j, f, 4.0 if j == "S" else y + float(rng.normal(0, 0.5)) + (1.0 if f == g == "a" else 0), y))
    spoilt = [tuple(None if i == k else v for i, v in enumerate(rows[0])) for k in range(6)]
    frame = spark.createDataFrame(rows + spoilt, FIELDS)
    found = {r.judge: tuple(r)[1:] for r in inference.self_preference(frame, *NAMES, "R", replicates=40).collect()}
    want = plain(rows, "R", 40)
    assert found.keys() == want.keys() == {"A", "B"}
    for j, values in want.items():
        assert found[j][:2] == values[:2] and np.abs(np.array(found[j][2:]) - np.array(values[2:])).max() < 1e-9
    assert found["A"][5] > 0 > found["B"][5]


def test_one_kind_of_score_and_nothing_to_hold_against(spark):
    rows = [(c, g, j, j.lower(), 1.0, 2.0) for c in range(3) for g in "ab" for j in "AR"]
    frame = spark.createDataFrame(rows, FIELDS)
    assert [tuple(r)[3:6] for r in inference.self_preference(frame, *NAMES, "R", replicates=5).collect()] == [(0.0, 0.0, 0.0)]
    assert inference.self_preference(frame.where("j = 'A'"), *NAMES, "R", replicates=5).collect() == []
    assert inference.self_preference(frame.where("false"), *NAMES, "R", replicates=5).collect() == []
    alone = inference.self_preference(frame.where("g = 'a'"), *NAMES, "R", replicates=5).collect()
    assert [(r.judge, r.contrast, r.low) for r in alone] == [("A", None, None)]
