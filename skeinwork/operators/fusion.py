"""Merging ranked lists over corpora and retrievers, and late lookup of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def together(lists: list[DataFrame]) -> DataFrame:
    """The rows of several searches (column query_id), each dealt by query once more before they meet. Without that Spark joins the searches'
    own shuffles part by part, and a task ranks the local lists of all searches; only the few hits that are left move here."""
    tasks = 2 * int(lists[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with the session's own number they count as dealt already
    return reduce(DataFrame.unionByName, [rows.repartition(tasks, "query_id") for rows in lists])


def merge_corpora(hits: DataFrame, ascending: bool = False) -> DataFrame:
    """hits (query_id, id, score, ...) of several corpora with one `rank` (from 0); distances rank ascending. Ties: least id."""
    order = F.col("score") if ascending else F.desc("score")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id")) - 1)


def reciprocal_rank_fusion(hits: DataFrame, k: int = 32, rrf_k: int = 100) -> DataFrame:
    """query_id, id, score, lists, rank of ranked lists (query_id, retriever, id, rank from 0).

    score = sum of 1 / (rrf_k + rank + 1); ties: the one first seen (lower retriever, then rank).
    """
    fused = hits.groupBy("query_id", "id").agg(
        F.sum(1 / (F.lit(float(rrf_k)) + F.col("rank") + 1)).alias("score"), F.count("*").alias("lists"), F.min(F.struct("retriever", F.col("rank").alias("at"))).alias("seen")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen")
    return fused.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1).drop("seen")


def over_fetch(k: int) -> int:
    """How many hits of each list fusion takes."""
    return max(2 * k, 100)


def lookup(hits: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """Texts to hits; an id without a chunk is an error when the row is read."""
    found = chunks.withColumn("__found", F.lit(True))
    joined = hits.join(found, key, "left")
    return joined.filter(F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no chunk with id "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("__found")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed upsert: of rows with one key the last by `order` stays."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("__at", at).filter("__at = 1").drop("__at")
