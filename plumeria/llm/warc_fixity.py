"""Fixity audit of web archives: Merkle trees over the ordered records of WARC shards, held against a replica's.

Leaves hash the bytes of a record and its byte range, inner nodes the hashes of up to ``FANOUT`` children, and the
shards' roots go up to one archive root. Two replicas agree when their roots do; otherwise only the children of
mismatching nodes are compared, level by level, down to the records that differ. Every level is a table of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm.common import stored

FANOUT = 16
SHARD_RECORDS = 4096


def _hash60(digest: Column) -> Column:
    """The first fifteen hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def record_bytes(record_id: Column, url: Column, body: Column) -> Column:
    """One WARC/1.1 resource record: header, body, and the two line ends that close it."""
    number = F.md5(record_id.cast("string"))
    parts = [F.substring(number, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    content = F.coalesce(body.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"),
        F.concat_ws("-", *parts),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def write_archive(pages: DataFrame, shard_records: int = SHARD_RECORDS, page_id: str = "page_id") -> DataFrame:
    """(shard, seq, page_id, offset, length, record) of every row of ``pages``, in the shared folder.

    A record's shard is drawn from its SHA-256, so shards hold about ``shard_records`` different records whatever the
    ids; within a shard records lie in order of page_id, a null one first, then of their hash. Equal rows are records
    of their own, one after the other. A null html gives an empty body. An empty table gives an empty archive.
    Places come from the ids, lengths and hashes alone; the records themselves are shuffled once, to be joined.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        record_bytes(F.col(page_id), F.col("url"), F.col("html")).alias("record"),
    ).withColumn("sha", F.sha2("record", 256))
    slim = rows.groupBy("page_id", "sha").agg(F.max(F.octet_length("record")).cast("long").alias("length"), F.count("*").alias("copies"))
    slim = stored(slim, "warc-slim")
    shards = (slim.agg(F.sum("copies").alias("n")).first()["n"] or 0) // shard_records + 1
    slim = slim.withColumn("shard", _hash60(F.col("sha")) % shards)
    order = Window.partitionBy("shard").orderBy(F.col("page_id").asc_nulls_first(), "sha").rowsBetween(Window.unboundedPreceding, -1)
    seq = F.coalesce(F.sum("copies").over(order), F.lit(0)).alias("seq")
    offset = F.coalesce(F.sum(F.col("copies") * F.col("length")).over(order), F.lit(0)).alias("offset")
    places = stored(slim.select("shard", seq, F.col("page_id").alias("_id"), "sha", offset, "length", "copies"), "warc-places")
    same = rows["page_id"].eqNullSafe(F.col("_id")) & (rows["sha"] == places["sha"])
    placed = ["shard", "seq", "page_id", "offset", "length", "record"]
    one = rows.join(places.where("copies = 1"), same).select(*placed)
    if places.where("copies > 1").isEmpty():
        return stored(one, "warc")
    many = rows.join(places.where("copies > 1"), same).select("shard", "seq", "page_id", "offset", "length", "record", "copies")
    many = many.dropDuplicates(["shard", "seq"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = many.withColumn("seq", F.col("seq") + F.col("copy")).withColumn("offset", F.col("offset") + F.col("copy") * F.col("length"))
    return stored(one.unionByName(many.select(*placed)), "warc")


@dataclass
class Tree:
    """Levels from the leaves (shard, seq) to the archive's root; each (shard, node, hash, parent)."""

    levels: list[DataFrame]
    in_shards: int


def merkle_tree(archive: DataFrame, fanout: int = FANOUT, shape: tuple[int, int] | None = None) -> Tree:
    """The hash tree of an archive; ``shape`` (greatest seq, greatest shard) makes trees of replicas alike."""
    leaf = F.sha2(F.concat(F.concat_ws(":", "offset", "length").cast("binary"), F.lit("\n").cast("binary"), F.col("record")), 256)
    level = stored(archive.select("shard", F.col("seq").alias("node"), leaf.alias("hash")), "warc-level")
    top = shape or extent(archive)
    levels, in_shards, width = [level], 0, top[0]
    while width > 0 or in_shards == 0:
        level = _parents(level, "node", fanout)
        levels.append(level)
        in_shards += 1
        width //= fanout
    # From here on a node is a group of shards.
    width = top[1]
    level = level.select(F.col("shard").alias("node"), "hash")
    levels[-1] = level.select(F.lit(0).cast("long").alias("shard"), "node", "hash")
    while width > 0:
        level = _parents(levels[-1], "node", fanout)
        levels.append(level)
        width //= fanout
    return Tree(levels, in_shards)


def extent(archive: DataFrame) -> tuple[int, int]:
    row = archive.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("a"), F.coalesce(F.max("shard"), F.lit(0)).alias("b")).first()
    return row["a"], row["b"]


def _parents(level: DataFrame, node: str, fanout: int) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct(F.col(node).alias("place"), F.col("hash"))))
    joined = F.array_join(F.transform(children, lambda x: F.concat_ws("=", x["place"].cast("string"), x["hash"])), ",")
    up = level.withColumn("up", F.floor(F.col(node) / fanout)).groupBy("shard", "up").agg(F.sha2(joined.cast("binary"), 256).alias("hash"))
    return stored(up.select("shard", F.col("up").alias("node"), "hash"), "warc-level")


def differing(one: Tree, two: Tree, fanout: int = FANOUT) -> DataFrame:
    """(shard, seq) of the leaves where two trees of one shape differ, found by descending mismatching branches."""
    suspects: DataFrame | None = None
    for depth in range(len(one.levels) - 1, -1, -1):
        a, b = one.levels[depth], two.levels[depth]
        if suspects is not None:
            if depth + 1 == one.in_shards:  # the level above names shards
                keys = suspects.select(F.col("node").alias("s"))
                narrow = lambda x, k=keys: x.join(k, x["shard"] == k["s"], "left_semi")
            else:
                keys = suspects.select(F.col("shard").alias("s"), F.col("node").alias("up"))
                narrow = lambda x, k=keys: x.join(k, (x["shard"] == k["s"]) & (F.floor(x["node"] / fanout) == k["up"]), "left_semi")
            a, b = narrow(a), narrow(b)
        both = a.select("shard", "node", F.col("hash").alias("x")).join(b.select("shard", "node", F.col("hash").alias("y")), ["shard", "node"], "full")
        suspects = stored(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("shard", "node"), "warc-suspects")
    return suspects.select("shard", F.col("node").alias("seq"))


def audit(archive: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(page_id, shard, seq, offset, length, record_sha256, status) of every record that either replica has.

    status is ok, changed, missing (not in the replica) or added (only there). Replicas agree on shard and seq of a
    record; a shard of more or fewer records is compared in the larger one's shape.
    """
    shape = tuple(map(max, extent(archive), extent(replica)))
    found = differing(merkle_tree(archive, fanout, shape), merkle_tree(replica, fanout, shape), fanout)
    keys = ["shard", "seq"]
    mine = archive.select(*keys, "page_id", "offset", "length", F.sha2("record", 256).alias("record_sha256"))
    theirs = replica.join(found, keys, "left_semi").select(*keys, F.struct("page_id", "offset", "length", F.sha2("record", 256).alias("record_sha256")).alias("other"))
    bad = found.join(theirs, keys, "left").withColumn("bad", F.lit(True))
    every = mine.withColumn("here", F.lit(True)).join(bad, keys, "full")
    status = F.when(F.col("here").isNull(), "added").when(F.col("bad").isNull(), "ok").when(F.col("other").isNull(), "missing").otherwise("changed")
    own = lambda c: F.when(F.col("here").isNull(), F.col("other")[c]).otherwise(F.col(c)).alias(c)
    return every.select(own("page_id"), "shard", "seq", own("offset"), own("length"), own("record_sha256"), status.alias("status"))


def damaged_copy(archive: DataFrame) -> DataFrame:
    """A replica with known faults: of 101 records about one has a byte changed, one is cut short, one is missing."""
    draw = F.coalesce(_hash60(F.md5(F.concat(F.lit("damage:"), F.col("page_id").cast("string")))), F.lit(0)) % 101
    half = F.floor(F.col("length") / 2).cast("int")
    text = F.col("record")
    flipped = F.concat(F.substring(text, F.lit(1), half), F.lit("\x00").cast("binary"), F.substring(text, half + 2, F.col("length").cast("int")))
    record = F.when(draw == 7, flipped).when(draw == 53, F.substring(text, F.lit(1), half)).otherwise(text)
    length = F.when(draw == 53, half.cast("long")).otherwise(F.col("length"))
    copy = archive.where(draw != 23).select("shard", "seq", "page_id", "offset", length.alias("length"), record.alias("record"))
    return stored(copy, "warc-replica")
