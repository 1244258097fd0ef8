"""The finding of the fifth round, on a small table that failed before."""

from __future__ import annotations

import random

from plumeria.plans.catalog import QUERIES
from tests.test_r03 import by_sql


def test_copies_of_the_queries_stay_off_the_driver(spark, tmp_path):
    """knn_vote: 96 copies of the asked vectors, which Spark took for one and broadcast, under its own limit of 10 MB."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], rng.randrange(3)) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["knn_vote"](spark, str(tmp_path))
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = by_sql("knn_vote", embeddings=f"{tmp_path}/embeddings.parquet", events=f"{tmp_path}/events.parquet")
    assert len(want) == 30
    assert sorted(map(tuple, rows)) == sorted(want)
