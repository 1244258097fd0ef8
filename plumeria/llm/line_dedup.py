"""Lines that documents repeat, found with two Bloom filters and confirmed exactly.

A first pass puts the hash of every line's key into a filter of what was seen once; a hash that is there already goes
into a second filter of what was seen twice. The filters of two tasks make one: what both have seen once was seen
twice. Every key that occurs in two documents passes the second filter, so only lines that pass it, the suspects, are
shuffled: their SHA-256 by key, where documents are counted exactly and the one that keeps the line is chosen. The
filters have a fixed number of bits whatever the input: beyond what they hold more lines are suspected, and the result
stays exact. A line that a third of all documents have is counted in parts, and its verdict meets its documents by salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm import blocks
from plumeria.llm.common import WHITE_SPACE, stored
from plumeria.llm.words import lean, slices

#: Bits of each filter (32 MB): 70 million distinct lines at one false suspect in a hundred.
BITS = 1 << 28
#: Bits that a key sets.
PROBES = 3
SHORTEST, LEAST_DOCUMENTS = 20, 3
#: Parts in which the documents of one key meet its verdict.
SALTS = 16


def line_keys(text: str | None, shortest: int = SHORTEST) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text, and the key of each: stripped of ASCII white space, A-Z in lower case; None where shorter."""
    lines = (text or "").split("\n")
    keys = [x.encode().lower() if len(x) >= shortest else None for x in (line.strip(WHITE_SPACE) for line in lines)]
    return lines, keys


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the masks of each hash's bits, a row each."""
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    place = (hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)
    return (place >> np.uint64(3)).astype(np.int64), np.left_shift(1, (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8)


class Filters:
    """What a task has seen once and twice."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)

    def add(self, hashes: np.ndarray, document: np.ndarray) -> None:
        """Hashes of keys and the number of the document of each; a key that one document repeats is seen once."""
        order = np.lexsort((document, hashes))
        hashes, document = hashes[order], document[order]
        first = np.ones(len(hashes), bool)
        first[1:] = hashes[1:] != hashes[:-1]
        other = ~first
        other[1:] &= document[1:] != document[:-1]
        begins = np.flatnonzero(first)
        if not len(begins):
            return
        place, mask = _probes(hashes[begins], self.bits)
        again = np.logical_or.reduceat(other, begins) | ((self.once[place] & mask) != 0).all(axis=1)
        np.bitwise_or.at(self.once, place.ravel(), mask.ravel())
        np.bitwise_or.at(self.twice, place[again].ravel(), mask[again].ravel())


def _merge(state: list[np.ndarray], places: np.ndarray, values: list[np.ndarray]) -> None:
    once, twice = state
    twice[places] |= values[1] | (once[places] & values[0])
    once[places] |= values[0]


def seen_twice(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, bits: int = BITS) -> np.ndarray:
    """The filter of the keys that two rows of ``docs`` have: ``bits`` / 8 bytes whatever the input."""
    if bits & (bits - 1) or bits < 8 * blocks.BLOCK:
        raise ValueError(f"bits must be a power of two from {8 * blocks.BLOCK} on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for batch in slices(batches):
            hashes, owner = [], []
            for i, one in enumerate(batch.column(0).to_pylist()):
                own = [xxhash.xxh3_64_intdigest(k) for k in line_keys(one, shortest)[1] if k is not None]
                hashes += own
                owner += [i] * len(own)
            filters.add(np.array(hashes, np.uint64), np.array(owner, np.int64))
        yield from blocks.block_rows([filters.once, filters.twice], TaskContext.get().partitionId())

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(run), blocks.SCHEMA)
    return blocks.whole(blocks.merged(rows, ["uint8", "uint8"], _merge), bits >> 3, "uint8", 1)


def _suspects(keys: list[bytes | None], twice: np.ndarray) -> list[int]:
    """The numbers of the lines whose key may be in two documents."""
    long = [i for i, k in enumerate(keys) if k is not None]
    place, mask = _probes(np.array([xxhash.xxh3_64_intdigest(keys[i]) for i in long], np.uint64), len(twice) * 8)
    return [long[i] for i in np.flatnonzero(((twice[place] & mask) != 0).all(axis=1))]


def deduped_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST_DOCUMENTS, bits: int = BITS
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of ``docs``: its text without the lines that it loses.

    A line's key is the line stripped of ASCII white space with A-Z in lower case. A key of at least ``shortest`` code
    points that ``least`` documents have stays in the one with the largest doc_id, with all its lines there, and goes
    from all others. Rows that share a doc_id are one document, so are those without one, which comes before all others.
    A null or empty text is one empty line; a text that loses all lines is empty. An empty table gives an empty result.
    Other columns are ignored, whatever their names. ``least`` is at least 2.
    """
    if least < 2:
        raise ValueError("a line that one document has is no repeat")
    spark = docs.sparkSession
    twice = spark.sparkContext.broadcast(seen_twice(docs, text, shortest, bits))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("digests", pa.list_(pa.binary()))])
        for batch in slices(batches, 128):
            out = []
            for id_, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = line_keys(one, shortest)[1]
                if found := {keys[i] for i in _suspects(keys, twice.value)}:
                    out.append({"doc_id": id_, "text": one, "digests": [hashlib.sha256(k).digest() for k in found]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            lines, keep = [], []
            for i, one in enumerate(batch.column(1).to_pylist()):
                own, keys = line_keys(one, shortest)
                if not _suspects(keys, twice.value):
                    keep.append(i)
                    lines.append(len(own))
            ids, texts = (column.take(pa.array(keep, pa.int64())) for column in batch.columns)
            none = pa.array(np.zeros(len(keep), np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lines, pa.int64()), none, texts.fill_null("")], names=["doc_id", "n_lines", "n_dropped", "text"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])
        for batch in slices(batches, 128):
            out = []
            for id_, one, lost in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "lost")), strict=True):
                lines, keys = line_keys(one, shortest)
                gone = set(lost or ())
                stay = [x for x, k in zip(lines, keys, strict=True) if k is None or hashlib.sha256(k).digest() not in gone] if gone else lines
                out.append({"doc_id": id_, "n_lines": len(lines), "n_dropped": len(lines) - len(stay), "text": "\n".join(stay)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    result = "doc_id long, n_lines long, n_dropped long, text string"
    texts = stored(rows.mapInArrow(lean(suspected), "doc_id long, text string, digests array<binary>"), "lines-suspects")
    held = texts.select("doc_id", F.explode("digests").alias("digest")).distinct()
    counts = held.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= least)
    counts = counts.select("digest", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    lost = salted.join(counts.hint("merge"), ["digest", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    lost = lost.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("digest").alias("lost"))  # a document's own lines
    again = texts.select("doc_id", "text").join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    again = again.select("doc_id", "text", "lost").mapInArrow(lean(rest), result)
    return rows.mapInArrow(lean(clean), result).unionByName(again)
