"""Clusters of items as topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.operators import two_way
from plumeria.plans.registry import query
from plumeria.sources.tables import items, table


def titled_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, id, vec, title): the items of a category that came out within one month; the first line of its document is an item's title."""
    title = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.split("text", "\n")[0].alias("title"))
    month = F.expr("pub_s div 2592000 * 1000 + category").alias("cluster")
    return items(spark, sf_dir).join(title, "item", "left").select(month, F.col("item").alias("id"), F.col("emb").alias("vec"), "title")


@query()
def topic_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the items of a category and month are two topics, with all that the decision rests on."""
    found, _ = two_way.split_decisions(titled_clusters(spark, sf_dir), 64)
    measures = ["all_intra", "intra0", "intra1", "centroid_dist", "dist_ratio", "silhouette", "names_jaccard", "dup_ratio"]
    return found.withColumns({k: F.round(k, 6) for k in measures})
