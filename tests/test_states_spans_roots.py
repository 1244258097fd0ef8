"""Mergeable profiles in any split and order, span overlaps against nested loops, calibrated means."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.functions import text
from plumeria.operators import inference, profile_state, quantiles, roots, search, spans
from plumeria.streaming import events as stream

DDL = "user_id long, s long, vec array<float>, category int"


def history():
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(6), rng.randrange(3 * 10**6), [rng.gauss(0, 1) for _ in range(4)], rng.choice([None, 1, 2, 3])) for _ in range(400)]
    return rows + [rows[0], (7, 5, [1.0, 0.0, 0.0, 0.0], 2), (8, None, [1.0] * 4, 1), (8, 4, None, 1), (None, 4, [1.0] * 4, 1)]


def plain_state(rows, user):
    own = [(s, np.array(v, np.float32).astype(float), c or 0) for u, s, v, c in rows if u == user and s is not None and v is not None]
    anchor = max(s for s, *_ in own)
    total = sum(v * 0.5 ** ((anchor - s) / profile_state.HALF_LIFE_S) for s, v, _ in own)
    return total, anchor, len(own), {c: sum(x[2] == c for x in own) for *_, c in own}


def same(row, want):
    assert (row.anchor_s, row.hist_len, row.counts) == want[1:]
    np.testing.assert_allclose(row.hist_sum, want[0], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_states_of_any_split(spark, monkeypatch, parts):
    monkeypatch.setattr(profile_state, "HELD", 2)
    rows = history()
    random.Random(parts).shuffle(rows)
    found = profile_state.profile_states(spark.createDataFrame(rows, DDL).repartition(parts)).collect()
    assert sorted(r.user_id for r in found) == [0, 1, 2, 3, 4, 5, 7]
    for r in found:
        same(r, plain_state(rows, r.user_id))


def test_stored_states_and_what_came_since(spark):
    rows = history()
    old, new = (profile_state.profile_states(spark.createDataFrame(x, DDL)) for x in (rows[100:], rows[:100]))
    for r in profile_state.merged_states(old.unionByName(new)).collect():
        same(r, plain_state(rows, r.user_id))
    a, b = ((np.ones(2), 5, 1, {}), (np.ones(3), 5, 1, {}))
    assert profile_state.merge(None, a) is a and profile_state.merge(a, None) is a and profile_state.merge(None, None) is None
    with pytest.raises(ValueError):
        profile_state.merge(a, b)
    assert profile_state.profile_states(spark.createDataFrame([], DDL)).collect() == []


def test_the_stream_comes_to_the_state_of_the_batch(spark, tmp_path):
    rows = [r for r in history() if r[0] is not None]
    for at in range(0, len(rows), 90):
        spark.createDataFrame(rows[at : at + 90], DDL).withColumnRenamed("vec", "emb").coalesce(1).write.mode("append").parquet(str(tmp_path))
    source = spark.readStream.schema("user_id long, s long, emb array<float>, category int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = stream.profiles(source.select("user_id", "s", "emb")).writeStream.format("memory").queryName("states").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in spark.table("states").collect():
        if r.user_id not in last or r.hist_len > last[r.user_id].hist_len:
            last[r.user_id] = r
    for r in profile_state.profile_states(spark.createDataFrame(rows, DDL)).collect():
        assert (last[r.user_id].anchor_s, last[r.user_id].hist_len) == (r.anchor_s, r.hist_len)
        np.testing.assert_allclose(last[r.user_id].hist_sum, r.hist_sum, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("size", [1, 8, spans.BIN])
def test_overlaps(spark, size):
    rng = random.Random(size)

    def some(n, longest):
        rows = []
        for k in range(n):
            begin = rng.randrange(-20, 400)
            rows.append((rng.choice(["a", "a", "b", None]), k, begin, begin + rng.randint(0, longest)))
        return [*rows, ("a", 900, None, 5), ("a", 901, 5, None), rows[0], rows[0]]

    left, right = some(80, 30), some(90, 200)
    want = sorted(
        (k, i, j, max(a, c), min(b, d)) for k, i, a, b in left for m, j, c, d in right if k == m and k is not None and None not in (a, b, c, d) and max(a, c) < min(b, d)
    )
    frame = lambda rows: spark.createDataFrame(rows, "key string, id long, begin long, end long")
    assert sorted(map(tuple, spans.overlaps(frame(left), frame(right), "key", size).collect())) == want and len(want) > 300
    # Thousands of short spans side by side: only neighbours are pairs.
    many = frame([("t", k, 10 * k, 10 * k + 11) for k in range(3000)])
    assert spans.overlaps(many, many, "key", max(size, 8)).count() == 3000 + 2 * 2999
    assert spans.overlaps(frame(left).limit(0), frame(right), "key").collect() == []


def test_calibrated(spark):
    rng = random.Random(2)
    z = [rng.gauss(0, 3) for _ in range(500)]
    frame = spark.createDataFrame([(x,) for x in [*z, None]], "z double")
    for target in (0.001, 0.3, 0.97):
        bias, rate = roots.calibrated(frame, "z", target)
        assert abs(sum(1 / (1 + math.exp(-(x + bias))) for x in z) / len(z) - target) < 1e-9 and abs(rate - target) < 1e-6
    for bad, target in ((frame.where("z IS NULL"), 0.5), (frame, 0.0), (frame, 1.0), (frame, 1e-30)):
        with pytest.raises(ValueError):
            roots.calibrated(bad, "z", target)


def test_smallest_that_holds(spark):
    rows = [("a", k, k not in (2, 5)) for k in range(1, 9)] + [("b", 1, True), ("b", 2, True), ("c", 1, True), ("c", 2, False), ("d", 1, False), ("d", 2, True), ("d", 2, None), ("d", 3, True)]
    found = search.smallest_that_holds(spark.createDataFrame(rows, "g string, k long, ok boolean"), "k", "ok", ["g"])
    assert {r.g: r.smallest for r in found.collect()} == {"a": 6, "b": 1, "c": None, "d": 3}
    assert search.smallest_that_holds(spark.createDataFrame([], "k long, ok boolean"), "k", "ok").collect()[0].smallest is None


def test_searched_on_equal_rows(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random(), rng.choice([0, 1, None])) for _ in range(200)]
    configs = search.configurations(spark, 5, {"w": (0.0, 1.0, "uniform"), "h": (1.0, 100.0, "log")})
    drawn = {r.config: (r.w, r.h) for r in configs.collect()}
    assert len(set(drawn.values())) == 5 and all(0 <= w < 1 and 1 <= h < 100 for w, h in drawn.values())
    found = search.searched(spark.createDataFrame(rows, "x double, y double, label int"), configs, F.col("w") * F.col("x") + F.col("y") / F.col("h"), "label").collect()
    good = [r for r in rows if r[2] is not None]
    for r in found:
        w, h = drawn[r.config]
        assert r.evaluated == len(good) and abs(r.fit - np.corrcoef([w * x + y / h for x, y, _ in good], [z for *_, z in good])[0, 1]) < 1e-9
    assert [r.config for r in sorted(found, key=lambda r: r.place)] == [r.config for r in sorted(found, key=lambda r: (-round(r.fit, 9), r.config))]


def test_weighted_kappa(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.randrange(5)) for _ in range(300)] + [(k, k) for k in range(4)] * 40
    a, b = np.array(rows).T
    want = []
    for w in (lambda d: (d != 0) * 1.0, np.abs, lambda d: d * d):
        expected = np.mean([w(a - y).mean() for y in b])
        want.append(1 - w(a - b).mean() / expected)
    frame = spark.createDataFrame([*rows, (None, 1), (1, None)], "a int, b int")
    found = inference.weighted_kappa(frame, "a", "b").first()
    assert found.n == len(rows)
    np.testing.assert_allclose(list(found)[1:], want, rtol=1e-12)
    assert list(inference.weighted_kappa(frame.where("a = 1 AND b = 1"), "a", "b").first())[1:] == [None] * 3
    assert list(inference.weighted_kappa(frame.limit(0), "a", "b").first()) == [0, None, None, None]


def test_normal_form(spark):
    rows = [("e\u0301a\u0308", "\xe9\xe4"), ("\u212b", "\xc5"), ("plain", "plain"), ("", ""), (None, None), ("\ud55c\u1100\u1161", "\ud55c\uac00")]
    found = spark.createDataFrame([(x,) for x, _ in rows], "t string").select(text.nfc("t").alias("n")).collect()
    assert [r.n for r in found] == [y for _, y in rows]


def test_percentiles(spark):
    rng = random.Random(6)
    groups = {"hot": [rng.lognormvariate(0, 2) for _ in range(20_000)], "ties": [float(rng.randrange(3)) for _ in range(5000)], "one": [7.0], "two": [1.0, 4.0], None: [3.0, 1.0, 2.0], "some": [rng.random() for _ in range(1234)]}
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]] + [("none", None)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    found = quantiles.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", shares)
    got = {(r.g, r.share): (r.n, r.percentile) for r in found.collect()}
    assert got.keys() == {(g, q) for g in groups for q in shares}
    for (g, q), (n, p) in got.items():
        assert n == len(groups[g]) and math.isclose(p, float(np.quantile(groups[g], q)), rel_tol=1e-12), (g, q)
    assert quantiles.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).collect() == []
