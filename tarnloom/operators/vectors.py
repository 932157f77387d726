"""Exact nearest neighbours by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of query vectors for one scan of the points, and queries that are multiplied with a batch of points at once.
QUERY_BYTES, QUERY_BLOCK = 256 << 20, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def nearest(points: DataFrame, vector: list[float], limit: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The `limit` points nearest to one vector, with rank and score; ties go by key. Tasks keep their own best."""
    best = points.withColumn("score", cosine(F.col(column), F.array(*[F.lit(float(x)) for x in vector]))).orderBy(F.desc("score"), key).limit(max(limit, 0))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def nearest_of_each(points: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", column: str = "embedding", held: int = QUERY_BYTES) -> DataFrame:
    """(query_id, key, score, rank): the nearest `limit` points of each query (query_id, vector).

    Queries are read as many at a time as fit in `held` bytes, for one scan of all points; a task keeps the best `limit`
    of each query over all its batches, and a window then ranks a query's few candidates."""
    out, kind, own = None, queries.schema["query_id"].dataType.simpleString(), points.schema[key].dataType.simpleString()
    as_id, as_key = (to_arrow_type(d.schema[c].dataType) for d, c in ((queries, "query_id"), (points, key)))
    for ids, matrix in _blocks(queries.select("query_id", "vector").where("vector is not null").toLocalIterator(), held):
        shared = points.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)
            for batch in batches:
                batch = batch.filter(batch.column("v").is_valid())
                if not batch.num_rows or not ids or limit < 1:
                    continue
                keys = np.asarray(batch.column("k").to_pylist())
                x = np.array(batch.column("v").to_pylist(), np.float64)
                norms = np.linalg.norm(x, axis=1)
                x /= np.where(norms > 0, norms, 1)[:, None]
                for a in range(0, len(ids), QUERY_BLOCK):
                    for q, s in enumerate(matrix[a : a + QUERY_BLOCK] @ x.T, a):
                        k = keys
                        if best[q] is not None:
                            near = np.flatnonzero(s >= best[q][1][-1]) if len(best[q][1]) == limit else np.arange(len(s))
                            if not len(near):
                                continue
                            k, s = np.concatenate([best[q][0], keys[near]]), np.concatenate([best[q][1], s[near]])
                        order = np.lexsort((k, -s))[:limit]
                        best[q] = k[order], s[order]
            for i, found in zip(ids, best, strict=True):
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found[0]), as_id), pa.array(found[0].tolist(), as_key), pa.array(found[1])], names=["query_id", key, "score"])

        found = points.select(F.col(key).alias("k"), F.col(column).alias("v")).mapInArrow(run, f"query_id {kind}, {key} {own}, score double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _blocks(rows: Iterator, held: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, unit vectors) of as many rows as fit in `held` bytes, one at least; one empty block if there are no rows."""
    ids: list = []
    vectors: list[np.ndarray] = []
    first = True
    for r in rows:
        v = np.asarray(r["vector"], np.float64)
        if ids and (len(ids) + 1) * v.nbytes > held:
            yield ids, np.array(vectors)
            ids, vectors, first = [], [], False
        ids.append(r["query_id"])
        vectors.append(v / n if (n := np.linalg.norm(v)) else v)
    if ids or first:
        yield ids, np.array(vectors)
