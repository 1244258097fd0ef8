"""The event log as a stream: source, windows, exactly-once rows and decayed profiles.

Each function takes a streaming (or static) DataFrame with ``user_id`` and a timestamp column and returns one; triggers,
sinks and checkpoints are the caller's (``writeStream``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumeria.operators import profile_state
from plumeria.operators.sessions import GAP_S

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
HALF_LIFE_S = profile_state.HALF_LIFE_S


def event_stream(spark: SparkSession, path: str, files: int = 16, lag_s: int = 2) -> DataFrame:
    """Events from a folder that Parquet files arrive in, at most ``files`` a batch, without those of the last ``lag_s`` seconds."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    events = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("item", F.get_json_object("props", "$.k").cast("long"))
    return events.where(F.col("ts") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(lag_s)))


def once(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "2 days") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def item_counts(events: DataFrame, size: str = "6 hours", slide: str | None = None, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """(start, end, item, n): counts in tumbling windows, or sliding ones if ``slide`` is given."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counts = events.withWatermark(time, late).groupBy(window.alias("w"), "item").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "item", "n")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """(user, start, last, n): sessions whose gaps don't exceed the limit, in whole seconds."""
    second = F.date_trunc("second", F.col(time))
    gaps = events.withColumn(time, second).withWatermark(time, late)
    found = gaps.groupBy(F.session_window(time, f"{GAP_S} seconds").alias("w"), user).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return found.select(user, F.col("w.start").alias("start"), "last", "n")


PROFILE = "user_id long, anchor_s long, hist_len long, hist_sum array<double>"


def profiles(clicks: DataFrame, half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """The state of each user after every batch: clicks as (user_id, s, emb), in any order.

    The state is that of ``operators.profile_state``, and a batch is one merge into it: neither the order of arrival nor
    the cut into batches matters. A click without a second or a vector isn't counted; vectors must have one length.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = None
        if state.exists:
            anchor, count, total = state.get
            own = (np.array(total), anchor, count, {})
        for part in parts:
            good = part[part["emb"].notna() & part["s"].notna()]
            if len(good):
                fresh = profile_state.from_events(good["s"].to_numpy(np.int64), np.stack(good["emb"]).astype(float), np.zeros(len(good), int), half_life_s)
                own = profile_state.merge(own, (*fresh[:3], {}), half_life_s)
        if own is not None:
            state.update((own[1], own[2], own[0].tolist()))
            yield pd.DataFrame({"user_id": [key[0]], "anchor_s": [own[1]], "hist_len": [own[2]], "hist_sum": [own[0].tolist()]})

    kept = "anchor_s long, hist_len long, hist_sum array<double>"
    return clicks.groupBy("user_id").applyInPandasWithState(update, PROFILE, kept, "update", GroupStateTimeout.NoTimeout)
