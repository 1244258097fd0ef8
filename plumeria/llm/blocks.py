"""Arrays that many tasks fill: each task gives its own as sparse rows of blocks, which are merged in a tree of shuffles.

A row holds the places of one block that are not zero, and their values in one or more arrays. A merging task holds
one block at a time, so memory doesn't depend on the size of the arrays or on the number of tasks; a block of very
many tasks is merged in parts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a block.
BLOCK = 1 << 16
#: Parts of one block that a task merges at most, but for the last level.
FAN = 64
SCHEMA = "block long, part long, places binary, values array<binary>"
_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("places", pa.binary()), ("values", pa.list_(pa.binary()))])

#: Adds values at the places of a block to the block's arrays.
Add = Callable[[list[np.ndarray], np.ndarray, list[np.ndarray]], None]


def block_rows(arrays: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    """The blocks of arrays of one length in which the first one has anything."""
    for at in range(0, len(arrays[0]), BLOCK):
        row = _row(at // BLOCK, part, [x[at : at + BLOCK] for x in arrays])
        if row is not None:
            yield row


def _row(block: int, part: int, arrays: list[np.ndarray]) -> pa.RecordBatch | None:
    places = np.flatnonzero(arrays[0])
    if not len(places):
        return None
    values = [x[places].tobytes() for x in arrays]
    return pa.RecordBatch.from_pylist([{"block": block, "part": part, "places": places.astype(np.uint16).tobytes(), "values": values}], schema=_ARROW)


def merged(rows: DataFrame, dtypes: list[str], add: Add, fan: int = FAN) -> DataFrame:
    """One row for each block of ``rows``: all its parts put together by ``add``, level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, []
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("block", "part", "places", "values")]
            for block, part, places, values in zip(*columns, strict=True):
                if (block, part) != key:
                    if key is not None and (row := _row(*key, state)) is not None:
                        yield row
                    key, state = (block, part), [np.zeros(BLOCK, d) for d in dtypes]
                add(state, np.frombuffer(places, np.uint16).astype(np.int64), [np.frombuffer(v, d) for v, d in zip(values, dtypes, strict=True)])
        if key is not None and (row := _row(*key, state)) is not None:
            yield row

    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // fan)
        rows = rows.withColumn("part", F.expr(f"part div {fan}") if tasks > 1 else F.lit(0).cast("long"))
        rows = rows.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(run, SCHEMA)
    return rows


def whole(rows: DataFrame, size: int, dtype: str, which: int = 0) -> np.ndarray:
    """Array number ``which`` of merged rows on the driver. ``size`` must have a fixed bound that the caller states."""
    out = np.zeros(-(-size // BLOCK) * BLOCK, dtype)
    for row in rows.select("block", "places", F.col("values")[which].alias("v")).toLocalIterator(prefetchPartitions=True):
        out[row["block"] * BLOCK + np.frombuffer(row["places"], np.uint16).astype(np.int64)] = np.frombuffer(row["v"], dtype)
    return out[:size]
