"""Minimal perfect hashing of 64-bit keys in shards, with the keys stored for verification.

A shard is built in one task: each level deals the keys that are left over an array of places; those alone at their
place set its bit and are done. The number of set bits before a key's bit is its slot, so n keys have the slots 0 to
n - 1. A key that isn't in the set may find some slot too; the key stored there tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from plumeria.llm.words import mix

#: Keys of a shard, about, and places for each key at a level.
SHARD_KEYS, ROOM = 1 << 15, 2
#: Leading bits of a key that name its bin.
BINS = 10
_LEVELS = 64
SCHEMA = "bin long, sub long, extra long, sizes array<int>, bits binary, keys binary"
ARROW = pa.schema([("bin", pa.int64()), ("sub", pa.int64()), ("extra", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("keys", pa.binary())])


def _places(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    salt = np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix(keys + salt) % np.asarray(size, np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(sizes of the levels, their bits as 64-bit words, the keys by slot) for distinct keys."""
    sizes, bits, stored = [], [], []
    while len(keys):
        if len(sizes) == _LEVELS:
            raise ValueError("keys must be distinct")
        size = -(-len(keys) * ROOM // 64) * 64
        place = _places(keys, len(sizes), size)
        alone = np.bincount(place, minlength=size)[place] == 1
        used = np.zeros(size, np.uint8)
        used[place[alone]] = 1
        stored.append(keys[alone][np.argsort(place[alone])])
        bits.append(np.packbits(used, bitorder="little").view(np.uint64))
        sizes.append(size)
        keys = keys[~alone]
    empty = np.empty(0, np.uint64)
    return sizes, np.concatenate([empty, *bits]), np.concatenate([empty, *stored])


def binned(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys as rows (bin, keys), the input of ``shards``."""
    cuts = np.searchsorted(keys, np.arange(1 << BINS, dtype=np.uint64) << np.uint64(64 - BINS)).tolist() + [len(keys)]
    rows = [{"bin": k, "keys": keys[low:up].tobytes()} for k, (low, up) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if low < up]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bin", pa.int64()), ("keys", pa.binary())]))


def cut(bin_: int, keys: np.ndarray, shard_keys: int = SHARD_KEYS) -> Iterator[dict]:
    """The shards of a bin's distinct keys, cut by the bits that follow the bin's into about ``shard_keys`` each."""
    extra = max(0, (len(keys) - 1).bit_length() - (shard_keys - 1).bit_length())
    sub = (keys >> np.uint64(64 - BINS - extra)) & np.uint64((1 << extra) - 1)
    for k in range(1 << extra):
        sizes, bits, stored = build(keys[sub == k])
        yield {"bin": bin_, "sub": k, "extra": extra, "sizes": sizes, "bits": bits.tobytes(), "keys": stored.tobytes()}


def shards(rows: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The shards of all keys in ``rows`` (bin, keys), each key once however often it comes.

    A task takes one bin of leading bits after another, and cuts it by the bits that follow into shards of about
    ``shard_keys``. It holds the keys of one bin.
    """

    def built(bin_: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        for one in cut(bin_, keys, shard_keys):
            yield pa.RecordBatch.from_pylist([one], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, waiting, held = None, np.empty(0, np.uint64), [], 0
        for batch in batches:
            for bin_, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bin_ != at:
                    if at is not None:
                        yield from built(at, np.unique(np.concatenate([keys, *waiting])))
                    at, keys, waiting, held = bin_, keys[:0], [], 0
                waiting.append(np.frombuffer(part, np.uint64))
                held += len(waiting[-1])
                if held > max(len(keys), 1 << 20):
                    keys, waiting, held = np.unique(np.concatenate([keys, *waiting])), [], 0
        if at is not None:
            yield from built(at, np.unique(np.concatenate([keys, *waiting])))

    return rows.repartition("bin").sortWithinPartitions("bin").mapInArrow(run, SCHEMA)


class Slots:
    """The slots of the keys of some bins, one shard's after another's."""

    def __init__(self, rows: list[Row]):
        rows = sorted(rows, key=lambda r: (r["bin"], r["sub"]))
        self.which, self.extra = np.full(1 << BINS, -1, np.int64), np.zeros(1 << BINS, np.uint64)
        for i, r in enumerate(rows):
            if not r["sub"]:
                self.which[r["bin"]], self.extra[r["bin"]] = i, r["extra"]
        depth = max((len(r["sizes"]) for r in rows), default=0)
        self.size = np.zeros((len(rows), depth), np.int64)
        for i, r in enumerate(rows):
            self.size[i, : len(r["sizes"])] = r["sizes"]
        ends = np.cumsum(self.size.ravel())
        self.base = (ends - self.size.ravel()).reshape(self.size.shape)
        empty = np.empty(0, np.uint64)
        self.bits = np.concatenate([empty, *(np.frombuffer(r["bits"], np.uint64) for r in rows)])
        self.keys = np.concatenate([empty, *(np.frombuffer(r["keys"], np.uint64) for r in rows)])
        self.before = np.zeros(len(self.bits) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.bits), out=self.before[1:])

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't in the set."""
        found = np.full(len(keys), -1, np.int64)
        bin_ = (keys >> np.uint64(64 - BINS)).astype(np.int64)
        extra, shard = self.extra[bin_], self.which[bin_]
        left = np.flatnonzero(shard >= 0)
        shard = shard + ((keys >> (np.uint64(64 - BINS) - extra)) & ((np.uint64(1) << extra) - np.uint64(1))).astype(np.int64)
        for level in range(self.size.shape[1]):
            size = self.size[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            bit = self.base[shard[left], level] + _places(keys[left], level, size)
            word, low = self.bits[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> low) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << low[hit]) - np.uint64(1)))
            found[left[hit]] = self.before[bit[hit] >> 6] + below
            left = left[~hit]
        hit = np.flatnonzero(found >= 0)
        found[hit[self.keys[found[hit]] != keys[hit]]] = -1
        return found
