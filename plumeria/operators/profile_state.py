"""A user's decayed profile as an associative state: any split and any order of the events gives the same one.

The state is the sum of the vectors, each halved every half-life up to the latest event (the anchor), the number of
events, and events by category. Two states merge by fading the older sum to the later anchor. The batch aggregate, a
rebuild of some users and the streaming processor all use this one merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF_LIFE_S = 7 * 86400
#: Users whose partial states a task holds before it hands them on.
HELD = 4096

#: (sum, anchor second, events, events by category)
State = tuple[np.ndarray, int, int, dict[int, int]]


def from_events(times: np.ndarray, vectors: np.ndarray, categories: np.ndarray, half_life_s: float = HALF_LIFE_S) -> State:
    """The state of one event and more, in any order."""
    anchor = int(times.max())
    names, n = np.unique(categories, return_counts=True)
    return np.exp2((times - anchor) / half_life_s) @ vectors, anchor, len(times), dict(zip(names.tolist(), n.tolist(), strict=True))


def merge(a: State | None, b: State | None, half_life_s: float = HALF_LIFE_S) -> State | None:
    """The state of both states' events; None is the state of no event."""
    if a is None or b is None:
        return a or b
    if a[1] < b[1]:
        a, b = b, a
    if len(a[0]) != len(b[0]):
        raise ValueError("vectors must have one length")
    return a[0] + b[0] * 2.0 ** ((b[1] - a[1]) / half_life_s), a[1], a[2] + b[2], {k: a[3].get(k, 0) + b[3].get(k, 0) for k in a[3].keys() | b[3].keys()}


DDL = "user_id long, hist_sum array<double>, anchor_s long, hist_len long, counts map<int,long>"
_SCHEMA = pa.schema([("user_id", pa.int64()), ("hist_sum", pa.list_(pa.float64())), ("anchor_s", pa.int64()), ("hist_len", pa.int64()), ("counts", pa.map_(pa.int32(), pa.int64()))])


def _rows(states: dict[int, State]) -> pa.RecordBatch:
    rows = [{"user_id": u, "hist_sum": s[0].tolist(), "anchor_s": s[1], "hist_len": s[2], "counts": sorted(s[3].items())} for u, s in states.items()]
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def merged_states(states: DataFrame, half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """One state a user from rows of states (``DDL``), such as a stored one and what came since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, None
        for batch in batches:
            done: dict[int, State] = {}
            for row in batch.to_pylist():
                if row["user_id"] != user:
                    if state is not None:
                        done[user] = state
                    user, state = row["user_id"], None
                one = np.array(row["hist_sum"]), row["anchor_s"], row["hist_len"], dict(row["counts"])
                state = merge(state, one, half_life_s)
            yield _rows(done)
        if state is not None:
            yield _rows({user: state})

    return states.repartition("user_id").sortWithinPartitions("user_id").mapInArrow(run, DDL)


def profile_states(events: DataFrame, half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """A row for each user of ``events`` (user_id, s, vec, category): its state.

    Tasks hand on partial states, so a user with a large part of all events reaches the merging task as a few rows a
    task. Events without user, second or vector are left out, a null category is 0 (none); repeated events count.
    """
    good = events.where("user_id IS NOT NULL AND s IS NOT NULL AND vec IS NOT NULL")
    good = good.select(F.col("user_id").cast("long"), F.col("s").cast("long"), F.col("vec").cast("array<double>"), F.coalesce("category", F.lit(0)).cast("int").alias("category"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, State] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            users, times, categories = (batch.column(k).to_numpy() for k in (0, 1, 3))
            vectors = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            order = np.argsort(users, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(users[order])) + 1):
                user = int(users[own[0]])
                held[user] = merge(held.get(user), from_events(times[own], vectors[own], categories[own], half_life_s), half_life_s)
            if len(held) >= HELD:
                yield _rows(held)
                held = {}
        yield _rows(held)

    return merged_states(good.mapInArrow(run, DDL), half_life_s)
