"""Joins of spans that overlap, by bins: a text with very many spans makes only pairs that overlap.

A span is half-open, [begin, end). Spans meet in the bins that both touch; a pair is made in the first of these alone,
so it comes once, and no pair is made to be ruled out but those of one bin that don't overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 256


def overlaps(left: DataFrame, right: DataFrame, key: str, bin_size: int = BIN) -> DataFrame:
    """(key, left_id, right_id, begin, end) for spans (key, id, begin, end) of one key: the part that both share.

    Empty spans, and those with a null key, begin or end, overlap with nothing; repeated ones give a row each. A key's
    spans are dealt over its bins; ``bin_size`` should be near the length of a usual span.
    """

    def dealt(spans: DataFrame, side: str) -> DataFrame:
        good = spans.where(F.col(key).isNotNull() & (F.col("begin") < F.col("end")))
        bins = F.explode(F.sequence(F.floor(F.col("begin") / bin_size), F.floor((F.col("end") - 1) / bin_size)))
        return good.select(F.col(key), bins.alias("bin"), F.col("id").alias(f"{side}_id"), F.col("begin").alias(f"{side}_begin"), F.col("end").alias(f"{side}_end"))

    both = dealt(left, "left").join(dealt(right, "right"), [key, "bin"])
    begin, end = F.greatest("left_begin", "right_begin"), F.least("left_end", "right_end")
    met = both.where((begin < end) & (F.col("bin") == F.floor(begin / bin_size)))
    return met.select(key, "left_id", "right_id", begin.alias("begin"), end.alias("end"))
