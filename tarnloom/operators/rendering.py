"""Results as text: numbered lines under their path, cut at a number of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnloom.functions import text

HEADER = "The following code sections were retrieved:\n"
CAP = 20_000


def snippet(path: Column, start: Column, content: Column) -> Column:
    rows = F.transform(text.lines(F.coalesce(content, F.lit(""))), lambda line, i: text.numbered(line, start + i))
    top = F.when(start > 1, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Path: "), path)), top, rows, F.array(F.lit("..."))), "\n")


def snippets_within(ranked: DataFrame, cap: int = CAP) -> DataFrame:
    """Ranked results (query_id, rank, file_path, start_line, content) with their snippet, up to the first that would
    exceed the cap: the bytes before a snippet grow with its rank, so those that fit are a prefix."""
    rows = ranked.withColumn("snippet", snippet(F.col("file_path"), F.col("start_line"), F.col("content"))).withColumn("_bytes", F.octet_length("snippet"))
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.lit(len(HEADER.encode())) + F.coalesce(F.sum(F.col("_bytes") + 1).over(before), F.lit(0)) + F.col("_bytes")
    return rows.withColumn("_used", used).where(F.col("_used") <= cap).drop("_used", "_bytes")


def render(ranked: DataFrame, cap: int = CAP) -> DataFrame:
    """(query_id, output): one text per query that has results."""
    kept = snippets_within(ranked, cap).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "snippet"))).alias("_s"))
    every = ranked.select("query_id").distinct().join(kept, "query_id", "left")
    parts = F.transform(F.coalesce("_s", F.array().cast("array<struct<rank:int,snippet:string>>")), lambda s: F.concat(F.lit("\n"), s["snippet"]))
    return every.select("query_id", F.concat(F.lit(HEADER), F.array_join(parts, "")).alias("output"))
