"""Labelled documents for the classifiers: the split that is never learned from, and a bounded sample of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.llm.common import stored


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for measuring: the crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: Column, limit: int, text: str, doc_id: str) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents that aren't held out, those of the least hashes of id.

    Rows with a null id or label are left out. An id counts once: with its greatest label, and of several documents
    with the text of the least hash. The sample's ids and labels, ``limit`` rows, are small enough to send to every
    task; its rows are stored, so the documents are read once however often the sample is.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("_id"), label.cast("int").alias("label"))
    chosen = chosen.where(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("_id")))
    chosen = chosen.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("text"))
    met = rows.join(F.broadcast(chosen), "_id").select("_id", "label", F.struct(F.xxhash64("text").alias("hash"), "text").alias("one"))
    return stored(met.groupBy("_id", "label").agg(F.min("one").alias("one")).select("one.text", "label"), "training")
