"""Hybrid retrieval of chunks: nearest vectors and full text, fused, diverse and complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnloom.functions import text
from tarnloom.operators import context, expansion, fulltext, ranking, vectors

OVERFETCH = 3


def post_filter(hits: DataFrame, language: str | None = None, symbol_type: str | None = None, path_glob: str | None = None) -> DataFrame:
    """Filters on hits that a limit has already cut."""
    hits = hits.where(F.col("language") == language) if language else hits
    hits = hits.where(F.col("symbol_type") == symbol_type) if symbol_type else hits
    return hits.where(text.glob_filter(F.col("file_path"), path_glob)) if path_glob else hits


def retrieve(
    docs: DataFrame,
    queries: DataFrame,
    index: fulltext.Index | fulltext.Scan | None = None,
    files: DataFrame | None = None,
    limit: int = 20,
    hybrid: bool = True,
    expand: bool = True,
    match: str = "all",
    language: str | None = None,
    symbol_type: str | None = None,
    path_pattern: str | None = None,
    per_file: int = ranking.PER_FILE,
    prefilter: bool = False,
    collection: str | None = None,
) -> DataFrame:
    """The best `limit` chunks of each query (query_id, query, vector) from documents with embedding, by rank.

    Chunks of two collections are two chunks, whatever their paths; with collection, docs hold that one alone and the
    text search keeps to it, though the index, and so its statistics, may span all. Both searches fetch OVERFETCH times the limit. Vector hits are filtered after that cut (before it with
    prefilter), text hits before it. A query without vector hits left has no results; without hybrid the vector order
    stands and cut-off chunks stay as they are."""
    fetch = OVERFETCH * limit
    docs = docs.withColumn("_key", F.concat_ws(":", "doc_id", "collection"))
    points = post_filter(docs, language, symbol_type, path_pattern) if prefilter else docs
    near = vectors.nearest_of_each(points, queries, fetch, key="_key").join(docs, "_key")
    near = post_filter(near, language, symbol_type, path_pattern)
    if not hybrid or index is None:
        return ranking.diversify(near, limit, per_file, key="_key").drop("_key")
    asked = queries.withColumn("query", expansion.expand(F.col("query"))) if expand else queries
    found = fulltext.search(index, docs, asked, fetch, match, collection, language, symbol_type, path_pattern)
    found = found.join(near.select("query_id").distinct(), "query_id", "left_semi")
    fused = ranking.fuse(near, found, key="_key").join(docs, "_key")
    best = ranking.diversify(fused, limit, per_file, key="_key").drop("_key")
    return context.expand(best, files) if files is not None else best.withColumn("expanded", F.lit(False))
