"""Exact deduplication through an extendible-hash index kept on shared files. DataFrame functions only.

A text's key is the 64-bit hash of its normalised form (without ASCII white space). The index holds one entry for
each key with its number of rows. The directory addresses buckets by the leading bits of the key: it starts with one
cell, and as long as a bucket holds more than ``bucket_capacity`` keys, it is split by the next bit (the directory
doubles), down to as many cells as the number of keys calls for. Owner tasks process ranges of the directory: the entries are written to the
shared folder ranged by bucket. Keys that several rows share form a chain; its texts are compared byte for byte, so
two texts with one hash stay apart, at any depth.

A hot group never meets in one task: entries and byte classes are pre-aggregated in the map tasks, and the rows of a
group meet their class in a join that adaptive execution can split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.llm.common import fresh_names, stored, without_white_space

BUCKET_CAPACITY = 4096
MAX_DEPTH = 16
#: Parts that the rows of one key are dealt into when their texts are gathered.
SALTS = 32


def _best(n_points: str = "n_points", doc_id: str = "doc_id") -> Column:
    """Orders rows of a class: those with a doc_id first, then most code points, then the smallest doc_id."""
    return F.max(F.struct(F.col(doc_id).isNotNull().alias("has_id"), F.col(n_points).alias("n"), F.bitwise_not(doc_id).alias("d")))


def directory(entries: DataFrame, bucket_capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cell, bucket, depth, n_keys) of the extendible directory over ``entries`` (column ``key``).

    One row for each non-empty cell of the finest directory, at most ``2**max_depth`` rows whatever the input. A
    bucket is named by its first cell; its depth is the least at which it holds no more than ``bucket_capacity``
    keys. A bucket that is overfull at the greatest depth stays so and is chained.
    """
    cells = entries.groupBy(cell_of("key", max_depth).alias("cell")).agg(F.count("*").alias("in_cell"))
    levels = cells.select("cell", "in_cell", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    first = F.expr(f"shiftleft(shiftrightunsigned(cell, {max_depth} - depth), {max_depth} - depth)")
    levels = levels.select("cell", "in_cell", "depth", first.alias("bucket"))
    buckets = levels.groupBy("depth", "bucket").agg(F.sum("in_cell").alias("n_keys"))
    fits = (F.col("n_keys") <= bucket_capacity) | (F.col("depth") == max_depth)
    return (
        levels.join(buckets.where(fits), ["depth", "bucket"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "bucket", "n_keys")).alias("b"))
        .select("cell", "b.bucket", "b.depth", "b.n_keys")
    )


def cell_of(key: str, max_depth: int = MAX_DEPTH) -> Column:
    """The directory cell of a key: its leading ``max_depth`` bits."""
    return F.shiftrightunsigned(key, 64 - max_depth)


def build_index(rows: DataFrame, bucket_capacity: int = BUCKET_CAPACITY, max_depth: int | None = None) -> DataFrame:
    """The index over ``rows`` (column ``key``), read back from the shared folder: key, n_rows, bucket, depth, n_keys.

    Entries lie in files ranged by bucket, ordered by key within a bucket; each file belongs to one owner task. Unless
    given, the greatest depth is ``MAX_DEPTH`` or four bits more than evenly spread keys need.
    """
    entries = stored(rows.groupBy("key").agg(F.count("*").alias("n_rows")), "dedup-entries")
    if max_depth is None:
        max_depth = min(60, max(MAX_DEPTH, math.ceil(math.log2(max(1, entries.count() / bucket_capacity))) + 4))
    cells = directory(entries, bucket_capacity, max_depth)
    if max_depth <= MAX_DEPTH:  # at most 2**16 rows of five integers, about 2 MB; a larger directory is joined
        cells = F.broadcast(cells)
    placed = entries.withColumn("cell", cell_of("key", max_depth)).join(cells, "cell").drop("cell")
    placed = placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    return stored(placed.select("key", "n_rows", "bucket", "depth", "n_keys"), "dedup-index")


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    bucket_capacity: int = BUCKET_CAPACITY,
    max_depth: int | None = None,
    key: Column | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; a null text counts as empty, and all empty texts
    form one group. Of equal texts the row with the most code points in the original text stays, then the one with
    the smallest doc_id. Rows with a null doc_id take part in the counts and are kept only in a group without other
    ids. Repeated rows with the same doc_id and text each give a row. An empty table gives an empty result. Other
    columns of ``docs`` are ignored, whatever their names. ``key`` replaces the 64-bit hash (for tests of chains).
    """
    return _decided(docs, text, doc_id, bucket_capacity, max_depth, key).drop("n_points", "keep_points")


def _decided(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    bucket_capacity: int = BUCKET_CAPACITY,
    max_depth: int | None = None,
    key: Column | None = None,
) -> DataFrame:
    """The rows of ``exact_dedup`` with their code points and those of the row that stays."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"))
    rows = rows.select("doc_id", F.char_length("text").alias("n_points"), without_white_space(F.col("text")).alias("norm"))
    rows = rows.withColumn("key", F.xxhash64("norm") if key is None else key)
    slim = stored(
        rows.select("doc_id", "n_points", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")),
        "dedup-rows",
    )
    index = build_index(slim, bucket_capacity, max_depth)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    chains = index.where("n_rows > 1").select("key", salt)

    # Byte classes of the chained keys: the text itself is a grouping key, and copies fall together before the shuffle.
    members = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(
        chains.hint("merge"), ["key", "salt"]
    )
    classes = members.groupBy("key", "norm").agg(_best().alias("best"), F.count("*").alias("group_size"))
    sized = stored(
        classes.select(
            "key",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.bitwise_not("best.d").alias("keep_id"),
            F.col("best.n").alias("best_points"),
            "group_size",
        ),
        "dedup-classes",
    )
    every = slim.join(sized, ["key", "text_sha256"], "left")  # a key without a chain has one row
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return every.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "n_points",
        F.coalesce("best_points", "n_points").alias("keep_points"),
    )


def kept_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns.

    Rows are told apart by doc_id; where an id, or null, has several rows, by their code points and the hash of the
    text too, and of rows that are equal in these one stays. Other columns may have any names.
    """
    id_, id_points, id_sha, own_points, own_sha = fresh_names(docs, "id_", "points_", "sha_", "own_points", "own_sha")
    rows = _decided(docs, text, doc_id)
    rows = rows.select("doc_id", "n_points", "text_sha256", (F.col("kept") & (F.col("n_points") == F.col("keep_points"))).alias("stays"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.bool_or("stays").alias("stays"))
    ids = stored(ids.where("n_rows > 1 OR NOT stays").select(F.col("doc_id").alias(id_), "stays"), "dedup-ids")
    own = F.col(doc_id).cast("long")
    one = docs.join(ids.select(id_), own.eqNullSafe(F.col(id_)), "left_anti")
    several = ids.where("stays").select(id_)
    if several.isEmpty():
        return one
    wanted = rows.where("stays").join(several, F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    wanted = wanted.select(F.col("doc_id").alias(id_), F.col("n_points").alias(id_points), F.col("text_sha256").alias(id_sha)).distinct()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = docs.join(several, own.eqNullSafe(F.col(id_)), "left_semi")
    named = named.withColumn(own_points, F.char_length(whole)).withColumn(own_sha, F.sha2(without_white_space(whole).cast("binary"), 256))
    found = named.join(wanted, own.eqNullSafe(F.col(id_)) & (F.col(own_points) == F.col(id_points)) & (F.col(own_sha) == F.col(id_sha)), "left_semi")
    return one.unionByName(found.dropDuplicates([own_sha]).drop(own_points, own_sha))
