"""Packing: concatenate and cut.

Pass one tokenises each input partition and notes every document's start within its partition; the partitions'
token totals (one number a partition) are summed up in order and give each partition its global offset. Pass two
cuts the concatenation into fixed windows; a document that crosses a window's edge leaves a boundary record in
each window it touches. No text and no token is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common, tokens

SEQUENCE = 1024
END_ID = 0
_TOKENS = "doc_id long, part int, local_start long, n long, ids binary"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, piece_ids binary"
)


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """A row per document: its ids and end_id as little-endian uint32, and where they start in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in common.slices(batch, "text", 4 << 20):
                out, starts, sizes = [], [], []
                for text in piece.column("text"):
                    ids = tokens.ids_of(tokenizer_path, text.as_py())
                    raw = np.append(ids, end_id).astype("<u4")
                    out.append(raw.tobytes())
                    starts.append(at)
                    sizes.append(len(raw))
                    at += len(raw)
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())],
                    names=["doc_id", "part", "local_start", "n", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.null_as_empty("text").alias("text"))
    return rows.mapInArrow(run, _TOKENS)


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """A row per piece of a document within a packed sequence: doc_id, start (its document's ids before it), length,
    ids_crc32, doc_tokens, sequence_id, offset and, if keep_ids, the ids themselves (piece_ids, uint32).

    Every sequence but the last is full, so there is no padding elsewhere. A null or empty text is end_id alone;
    a null doc_id stays null; repeated rows are packed as often as they come; an empty table gives no rows.
    Columns besides doc_id and text are ignored, whatever their names. A text of any length is cut into as many
    windows as it needs. Rows are packed in the order of the table's partitions; the token table is written once,
    so a retried task cuts the same windows."""
    spark = common.bound_batches(docs.sparkSession)
    table = common.stash(tokenise(docs, tokenizer_path or tokens.default_path(), end_id), "packing-ids")
    totals = sorted((r["part"], r["total"]) for r in table.groupBy("part").agg(F.max(F.col("local_start") + F.col("n")).alias("total")).collect())
    bases, at = {}, 0  # one entry an input partition
    for part, total in totals:
        bases[part] = at
        at += total
    shared = spark.sparkContext.broadcast(bases)
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            held = 0

            def flush() -> pa.RecordBatch:
                kinds = [pa.int64()] * 7 + [pa.binary()]
                out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
                for c in columns:
                    c.clear()
                return out

            for doc_id, part, local, n, ids in zip(*(batch.column(c) for c in ("doc_id", "part", "local_start", "n", "ids")), strict=True):
                doc, total, raw = doc_id.as_py(), n.as_py(), ids.as_buffer()
                place, start = shared.value[part.as_py()] + local.as_py(), 0
                while start < total:
                    sequence, offset = divmod(place + start, length)
                    size = min(length - offset, total - start)
                    cut = memoryview(raw)[start * 4 : (start + size) * 4]
                    row = (doc, start, size, zlib.crc32(cut), total, sequence, offset, bytes(cut) if keep_ids else None)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    start += size
                    held += size
                if held > 1 << 20:
                    yield flush()
                    held = 0
            if columns[0]:
                yield flush()

    out = table.mapInArrow(run, _PIECES)
    return out if keep_ids else out.drop("piece_ids")
