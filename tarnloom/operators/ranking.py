"""Fusing ranked lists and keeping results diverse. Every list is a DataFrame with an explicit rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RRF_K = 60
VECTOR_WEIGHT, TEXT_WEIGHT = 0.7, 0.3
PER_FILE = 3


def fuse(vector_hits: DataFrame, text_hits: DataFrame, key: str = "doc_key", k: int = RRF_K, weights: tuple[float, float] = (VECTOR_WEIGHT, TEXT_WEIGHT)) -> DataFrame:
    """(query_id, key, score, rank) from two lists of (query_id, key, rank): the sum of weight / (k + rank) over all
    places of a key. Ties keep the order in which a key first comes, vector hits first."""
    lists = [d.select("query_id", key, "rank", F.lit(w).alias("_w"), F.lit(n).alias("_list")) for n, (d, w) in enumerate(zip((vector_hits, text_hits), weights, strict=True))]
    both = lists[0].unionByName(lists[1])
    summed = both.groupBy("query_id", key).agg(F.sum(F.col("_w") / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "_first")
    return summed.withColumn("rank", F.row_number().over(order)).drop("_first")


def diversify(ranked: DataFrame, limit: int, per_file: int = PER_FILE, key: str = "doc_key", path: str = "file_path") -> DataFrame:
    """The first `limit` rows of each query by rank, each key once and each file at most per_file times, ranked anew.
    A limit below 1 gives no rows."""
    first = Window.partitionBy("query_id", key).orderBy("rank")
    within = Window.partitionBy("query_id", path).orderBy("rank")
    rows = ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rows = rows.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= per_file)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= limit)
    return rows.drop("rank").withColumnRenamed("_n", "rank")
