"""Exact nearest vectors by inner product: packed blocks of vectors meet packed blocks of queries, a matrix product each.

Every vector and every query is looked at. A task holds one block of each side and a strip of their products; per query
and block it gives the best few, so what is merged is a few rows a query and block. Products of a block only tell which
pairs may be among the best; these are added up again in order of the elements, so that results don't depend on blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks to which the vectors are dealt, and queries whose products with a block are held at once.
BLOCKS, STRIP = 96, 128
#: Pairs that are added up again at once.
PAIRS = 1 << 14
_TILE = "block int, ids array<long>, tags array<long>, size int, vectors binary"
_FOUND = "q long, q_tag long, id long, tag long, s double"
#: The products of pairs that have none, and of pairs that aren't looked at.
_NONE, _SAME = np.finfo(float).min, -np.inf


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, id, tag, vec) as tiles: vectors of one block and size, a batch at most."""
    schema = pa.schema([("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("size", pa.int32()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("block", "size"))
            for b, n in sorted(set(zip(block.tolist(), size.tolist(), strict=True))):
                own = batch.take(pa.array(np.flatnonzero((block == b) & (size == n))))
                vectors = own.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).tobytes() if n > 0 else b""
                yield pa.RecordBatch.from_pylist([{"block": b, "ids": own.column("id").to_pylist(), "tags": own.column("tag").to_pylist(), "size": n, "vectors": vectors}], schema=schema)

    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    sized = rows.where("id IS NOT NULL").select("block", F.col("id").cast("long"), F.col("tag").cast("long"), F.when(whole, F.size("vec")).otherwise(-1).alias("size"), F.when(whole, F.col("vec")).cast("array<double>").alias("vec"))
    return sized.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, _TILE)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of pairs of rows, added up from the first element on."""
    return np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def candidates(queries: np.ndarray, vectors: np.ndarray | None, asked: np.ndarray, ids: np.ndarray, most: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, vector number, product) of what may be among a query's ``most`` best, a strip of queries at a time.

    Ranks go by the product rounded to ``digits``, greatest first, then the least id; a query isn't held against its own
    id. Without ``vectors``, no pair has a product. Of pairs that tie exactly only the first ``most`` by id are given.
    """
    by_id = np.argsort(ids, kind="stable")
    with np.errstate(all="ignore"):
        longest = np.sqrt((vectors * vectors).sum(axis=1).max()) if vectors is not None else 0.0
        for at in range(0, len(asked), STRIP):
            own = asked[at : at + STRIP]
            q = queries[at : at + STRIP] if vectors is not None else None
            s = q @ vectors.T if vectors is not None else np.full((len(own), len(ids)), _NONE)
            s[np.isnan(s)] = np.inf
            low, high = np.searchsorted(ids, own, "left", sorter=by_id), np.searchsorted(ids, own, "right", sorter=by_id)
            for i in np.flatnonzero(high > low):
                s[i, by_id[low[i] : high[i]]] = _SAME
            k = max(len(ids) - most, 0)
            slack = 2 * 10.0**-digits + 1e-13 * longest * (np.sqrt((q * q).sum(axis=1)) if q is not None else np.zeros(len(own)))
            least = np.partition(s, k, axis=1)[:, k] - slack
            least[np.isnan(least)] = -np.inf
            i, j = np.nonzero((s >= least[:, None]) & (s > _SAME))
            exact = s[i, j]
            if vectors is not None:
                for b in range(0, len(i), PAIRS):
                    part = slice(b, b + PAIRS)
                    exact[part] = _sum(q[i[part]], vectors[j[part]])
            order = np.lexsort((ids[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])
            place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) if len(i) else np.zeros(0, int)
            keep = place < most
            yield i[keep] + at, j[keep], exact[keep]


def nearest(vectors: DataFrame, queries: DataFrame, most: int, digits: int = 9, blocks: int = BLOCKS) -> DataFrame:
    """(q, q_tag, id, tag, s, place): each query's ``most`` best of the vectors, itself left out.

    Both tables are (id, tag, vec); tags are whole numbers that go along. ``s`` is the inner product rounded to
    ``digits``; order is by s from the greatest, NaN first and null last, then by id. It is null where either vector is,
    holds a null, or has another length. Rows without id are left out.
    """
    here = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # Queries are packed before they are sent to every block.
    sent = _packed(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(8)).cast("int")), 8).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = _packed(here, blocks)
    sent = sent.select("block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "tags", "size", "vectors")]).repartition(blocks, "block")
    # Spark takes the copies for as small as the one that is copied, and would send all of them by way of the driver.
    pairs = tiles.join(sent.hint("merge"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("ids", "tags", "size", "vectors", "q_ids", "q_tags", "q_size", "q_vectors")
        for batch in batches:
            for k in range(batch.num_rows):
                ids, tags, size, data, asked, q_tags, q_size, q_data = (batch.column(n)[k] for n in names)
                ids, asked = (x.values.to_numpy(zero_copy_only=False) for x in (ids, asked))
                alike = size.as_py() == q_size.as_py() >= 0
                a, q = (np.frombuffer(x.as_py(), float).reshape(-1, size.as_py()) if alike and size.as_py() else np.zeros((len(y), 0)) for x, y in ((data, ids), (q_data, asked)))
                for i, j, s in candidates(q, a if alike else None, asked, ids, most, digits):
                    value = pa.array(s) if alike else pa.nulls(len(s), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(asked[i]), q_tags.values.take(pa.array(i)), pa.array(ids[j]), tags.values.take(pa.array(j)), value], ["q", "q_tag", "id", "tag", "s"])

    found = pairs.select("ids", "tags", "size", "vectors", "q_ids", "q_tags", "q_size", "q_vectors").mapInArrow(run, _FOUND)
    found = found.withColumn("s", F.round("s", digits))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))  # a few rows a block
    return found.withColumn("place", place).where(F.col("place") <= most)
