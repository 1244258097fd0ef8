"""Connected components of a table of links, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.common import Tables, stored


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")
    ).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (columns a, b); component is the smallest id reachable.

    Alternates the large-star and small-star steps (each replaces links by links to the least neighbour, keeping
    connectivity) until the links no longer change; each becomes a star with the least id in its centre. Every round
    is written to the shared folder, where only the result stays; the driver sees one count and one checksum of a round. A hub with very many
    neighbours is aggregated in parts before its shuffle and joined by a join that adaptive execution splits.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    tables = Tables(links.sparkSession, "components")
    edges = tables.store(edges, "links")
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = tables.store(small, "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("id")).distinct()
    every = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    every = stored(every.unionByName(roots.select("id", F.col("id").alias("component"))), "components")
    tables.drop()
    return every
