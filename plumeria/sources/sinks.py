"""Writing: idempotent inserts, replacing a day, lists by user, JSON lines with a counted trailer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to insert: of each key the first, unless the key is known. Rows without a key are left out."""
    firsts = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    fresh = firsts.join(known.select(key).distinct(), key, "left_anti")
    return incoming.join(fresh, [key, order], "left_semi").dropDuplicates([key])


def insert(incoming: DataFrame, path: str, key: str, order: str) -> tuple[int, int]:
    """Append the new rows to a Parquet table; (inserted, skipped)."""
    spark = incoming.sparkSession
    known = spark.read.schema(incoming.schema).option("pathGlobFilter", "*.parquet").parquet(path) if _exists(spark, path) else spark.createDataFrame([], incoming.schema)
    rows = new_rows(incoming, known, key, order).persist()
    n = rows.count()
    rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n, incoming.count() - n


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that ``df`` has, and no other; the same write twice leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def lists_by_user(ranked: DataFrame, user: str, rank: str, item: str) -> DataFrame:
    """One row a user with the JSON array of its items in order."""
    lists = ranked.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(rank, item))).alias("l"))
    return lists.select(user, F.to_json(F.transform("l", lambda x: x[item])).alias("items"))


def export_json(df: DataFrame, path: str) -> int:
    """JSON lines and beside them a trailer with the number of rows; the number as read back."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{path}/rows")
    n = spark.read.schema(df.schema).json(f"{path}/rows").count()
    spark.createDataFrame([(n,)], "rows long").coalesce(1).write.mode("overwrite").json(f"{path}/trailer")
    return n
