"""Runs of characters that texts share with known texts: a filter of the known runs' hashes first, then the runs themselves.

The filter has a fixed number of bits. A task hashes all runs of a text by doubling, whole arrays at a time, and gives only
those that pass; these are joined with the known runs exactly. Beyond what the filter holds more runs pass it, and the
result stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter (8 MB): four million known runs at one false suspect in a hundred.
BITS = 1 << 26
#: Rows that are given at once, and code points of a text that are hashed at once.
TOGETHER, PIECE = 4096, 1 << 18


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` code points, by hashes of runs of powers of two."""
    with np.errstate(over="ignore"):
        power, size, base = points.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
        out, done = np.zeros(max(len(points) - n + 1, 0), np.uint64), 0
        while len(out):
            if n & size:
                out = out * np.uint64(pow(base, size, 1 << 64)) + power[done : done + len(out)]
                done += size
            if done == n:
                break
            power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _passed(text: str, n: int, held: np.ndarray | None, bits: int) -> Iterator[str]:
    """The distinct runs of a text whose bits ``held`` has, all without one."""
    found = set()
    for at in range(0, len(text) - n + 1, PIECE):
        part = text[at : at + PIECE + n - 1]
        if held is None:
            found.update(part[i : i + n] for i in range(len(part) - n + 1))
            continue
        h = hashes(np.frombuffer(part.encode("utf-32-le"), np.uint32), n)
        one, two = _places(h, bits)
        first = np.flatnonzero((held[one >> 3] >> (one & 7).astype(np.uint8)) & 1)
        two = two[first]
        found.update(part[i : i + n] for i in first[((held[two >> 3] >> (two & 7).astype(np.uint8)) & 1) == 1])
    yield from found


def _runs(texts: DataFrame, n: int, held=None, bits: int = BITS) -> DataFrame:
    """(id, g): distinct runs of each text of (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("g", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, runs = [], []
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                for g in _passed(text.as_py() or "", n, None if held is None else held.value, bits):
                    ids.append(id_.as_py())
                    runs.append(g)
                    if len(ids) == TOGETHER:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.string())], schema=schema)
                        ids, runs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.string())], schema=schema)

    return texts.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, g string")


def _filter(known: DataFrame, n: int, bits: int) -> np.ndarray:
    """The bits of the known runs as bytes: ``bits`` / 8 whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(hashes(points, n)[::n], bits)))], ["place"])

    places = known.select("g").mapInArrow(run, "place long")
    words = places.groupBy(F.expr("place div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(place % 64)))").alias("word"))
    found = words.toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return out.view(np.uint8)


def shared(texts: DataFrame, known: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """(id, shared): for rows of (id, text), the number of distinct runs of ``n`` characters that a known text has.

    ``known`` has a column text. Rows without such a run aren't in the result; rows of one id are added up. A null text
    has no runs. ``bits`` is a power of two from 64 on.
    """
    runs = _runs(known.select(F.lit(0).alias("id"), "text"), n).select("g").distinct()
    held = texts.sparkSession.sparkContext.broadcast(_filter(runs, n, bits))
    return _runs(texts, n, held, bits).join(runs, "g", "left_semi").groupBy("id").agg(F.count("*").alias("shared"))
