"""Keeping stored chunks up to date, as pure transformations of their table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tarnloom.functions import text


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("collection", "point_id"), version: str = "version") -> DataFrame:
    """Both tables with the latest version of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    both = stored.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def delete_paths(stored: DataFrame, paths: DataFrame, collection: str | None = None) -> DataFrame:
    """stored without the rows of paths (file_path), in one collection or in all."""
    gone = paths.select(F.col("file_path").alias("_gone")).distinct()
    match = F.col("file_path") == F.col("_gone")
    return stored.join(gone, match & (F.col("collection") == collection) if collection else match, "left_anti")


def count_deleted(stored: DataFrame, paths: DataFrame, collection: str | None = None) -> DataFrame:
    """One row: n_deleted."""
    rows = stored.where(F.col("collection") == collection) if collection else stored
    return rows.join(paths.select("file_path").distinct(), "file_path", "left_semi").agg(F.count("*").alias("n_deleted"))


def clear(stored: DataFrame, collection: str | None = None) -> DataFrame:
    return stored.where(F.col("collection") != collection) if collection else stored.limit(0)


def collections(stored: DataFrame) -> DataFrame:
    return stored.select("collection").distinct()


def statistics(stored: DataFrame, collection: str | None = None) -> DataFrame:
    """One row: total_chunks and unique_files."""
    rows = stored.where(F.col("collection") == collection) if collection else stored
    return rows.agg(F.count("*").alias("total_chunks"), F.countDistinct("file_path").alias("unique_files"))


def file_hashes(stored: DataFrame, collection: str | None = None) -> DataFrame:
    """(file_path, content_hash): of a file with several, that of the largest point_id; rows without one don't count."""
    rows = stored.where(F.col("collection") == collection) if collection else stored
    rows = rows.where((F.col("content_hash") != "") & (F.col("file_path") != ""))
    return rows.groupBy("file_path").agg(F.max_by("content_hash", "point_id").alias("content_hash"))


def hash_diff(stored: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, status): new, changed, deleted or same, from stored and present hashes (file_path, content_hash)."""
    a = stored.select("file_path", F.col("content_hash").alias("_old"))
    b = files.select("file_path", F.col("content_hash").alias("_new"), F.lit(True).alias("_here"))
    rows = a.withColumn("_there", F.lit(True)).join(b, "file_path", "full_outer")
    status = F.when(F.col("_there").isNull(), "new").when(F.col("_here").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return rows.select("file_path", status.alias("status"))


def with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("point_id", text.point_id(text.doc_key()))
