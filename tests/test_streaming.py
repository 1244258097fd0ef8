from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import numpy as np

from plumeria.streaming import events

T0 = dt.datetime(2024, 1, 1)


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name).collect()


def log(spark, path, rows):
    """One file for each run of 40 events."""
    for at in range(0, len(rows), 40):
        spark.createDataFrame(rows[at : at + 40], events.EVENTS).coalesce(1).write.mode("append").parquet(path)


def sample():
    rng = random.Random(1)
    seconds = sorted(rng.randrange(86400) for _ in range(200))
    return [(i, T0 + dt.timedelta(seconds=s), rng.randrange(4), "click", 1.0, f'{{"k": {rng.randrange(6)}}}') for i, s in enumerate(seconds)]


def test_counts_and_repeats(spark, tmp_path):
    rows = sample()
    log(spark, str(tmp_path), rows + rows[:20])
    single = events.once(events.event_stream(spark, str(tmp_path)))
    assert sorted(x.event_id for x in run(single, "single", "append")) == list(range(200))
    found = run(events.item_counts(events.event_stream(spark, str(tmp_path / "")), late="2 days"), "counts", "complete")
    want = Counter()
    for _, ts, _, _, _, props in rows + rows[:20]:
        want[(ts.hour // 6, int(props[6:-1]))] += 1
    assert Counter({(x.start.hour // 6, x.item): x.n for x in found}) == want


def test_sessions(spark, tmp_path):
    times = [0, 1800, 3601, 9000]
    log(spark, str(tmp_path), [(i, T0 + dt.timedelta(seconds=s), 1, "click", 1.0, "{}") for i, s in enumerate(times)])
    found = run(events.sessions(events.event_stream(spark, str(tmp_path))), "sessions", "complete")
    assert sorted(x.n for x in found) == [1, 1, 2]


def test_profiles_do_not_depend_on_arrival(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(10**6), [rng.random() for _ in range(4)]) for _ in range(90)] + [(7, 5, None)]
    rng.shuffle(rows)
    for at in range(0, len(rows), 30):
        spark.createDataFrame(rows[at : at + 30], "user_id long, s long, emb array<float>").coalesce(1).write.mode("append").parquet(str(tmp_path))
    clicks = spark.readStream.schema("user_id long, s long, emb array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = {}
    for x in run(events.profiles(clicks), "profiles", "update"):
        if x.user_id not in found or x.hist_len > found[x.user_id].hist_len:
            found[x.user_id] = x
    assert set(found) == {0, 1, 2}
    for user, x in found.items():
        own = [(s, np.array(e, np.float32).astype(float)) for u, s, e in rows if u == user]
        anchor = max(s for s, _ in own)
        want = sum(e * 0.5 ** ((anchor - s) / events.HALF_LIFE_S) for s, e in own)
        assert (x.anchor_s, x.hist_len) == (anchor, len(own))
        np.testing.assert_allclose(x.hist_sum, want, rtol=1e-9)
