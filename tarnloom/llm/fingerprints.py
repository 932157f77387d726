"""Document fingerprints: closed syncmers over code points.

A k-mer is an anchor if the smallest hash of its inner s-mers lies at its first or its last one, which depends on
the k-mer alone. A fingerprint lists the anchors with hashes up to BOUND, or the ANCHORS smallest if these are more, and
their positions, in text order; two fingerprints are alike by the share of anchors, among the hashes up to which both
are complete, that match and lie in one order.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

K, S = 24, 8
#: For texts of fewer than 2 * SHORT code points there are anchors of this finer size too.
FINE_K, FINE_S = 8, 4
SHORT = 160
#: Anchors of a scale in a fingerprint, at least (all, if there are fewer), and the hash up to which every anchor stays: a
#: quarter of all.
ANCHORS, BOUND = 64, 1 << 30
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(position, 64-bit hash) of the closed syncmers of one run of code points; all of a shorter text is one anchor."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = common.mix64(points.astype(np.uint64) + np.uint64(1))
    if n < k:
        h = np.uint64(n)
        for v in x.tolist():
            h = common.mix64(np.array([(int(h) * int(_MULT) + v) & (2**64 - 1)], np.uint64))[0]
        return np.zeros(1, np.int64), np.array([h], np.uint64)
    inner = _windows(x, s)
    small = _mins(inner, k - s + 1)
    at = np.flatnonzero((inner[: n - k + 1] == small) | (inner[k - s :] == small))
    return at, common.mix64(_windows_at(inner, at, k, s))


def _windows(x: np.ndarray, s: int) -> np.ndarray:
    """Hashes of all runs of s (a power of two) values, by doubling."""
    h, span = x, 1
    while span < s:
        factor = np.uint64(pow(int(_MULT), span, 2**64))
        h = h[: len(h) - span] * factor + h[span:]
        span *= 2
    return common.mix64(h)


def _mins(x: np.ndarray, w: int) -> np.ndarray:
    """Sliding minimum over w values, by doubling."""
    out, span = x, 1
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1])


def _windows_at(inner: np.ndarray, at: np.ndarray, k: int, s: int) -> np.ndarray:
    """Hashes of the k-mers at the given places, from the s-mers that cover them."""
    h = np.zeros(len(at), np.uint64)
    for step in [*range(0, k - s, s), k - s]:
        h = h * _MULT + inner[at + step]
    return h


def sketch(points: np.ndarray, size: int = ANCHORS) -> np.ndarray:
    """(hash, position) as uint32 pairs in text order: of each scale the anchors with hashes up to BOUND and at
    least the `size` smallest, each hash once. The hash's lowest bit is 1 for fine anchors."""
    parts = []
    for fine in (0, 1):
        if fine and len(points) >= 2 * SHORT:
            continue
        at, h = anchors(points, *((FINE_K, FINE_S) if fine else (K, S)))
        h, first = np.unique(h >> np.uint64(32) & np.uint64(0xFFFFFFFE) | np.uint64(fine), return_index=True)
        n = max(size, int(np.searchsorted(h, BOUND, "right")))
        h, at = h[:n], at[first[:n]]
        order = np.argsort(at, kind="stable")
        parts.append(np.stack([h[order], np.minimum(at[order], 2**32 - 1)], axis=1).astype(np.uint32))
    return np.concatenate(parts)


def pack(sk: np.ndarray) -> str:
    return base64.b64encode(sk.astype("<u4").tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)


def likeness(a: np.ndarray, b: np.ndarray, size: int = ANCHORS) -> float:
    """Of both's hashes up to where each is complete (all, if a sketch has fewer than `size`), the share that both
    hold in one order (the longest rising run of positions). Fine anchors are compared where both have them, the others elsewhere; 1 for two empty fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    fine = bool((a[:, 0] & 1).any() and (b[:, 0] & 1).any())
    a, b = a[(a[:, 0] & 1) == fine], b[(b[:, 0] & 1) == fine]
    if not len(a) or not len(b):
        return 0.0
    last = min(max(BOUND, int(x[:, 0].max())) if len(x) >= size else 2**32 for x in (a, b))
    a, b = a[a[:, 0] <= last], b[b[:, 0] <= last]
    union = np.union1d(a[:, 0], b[:, 0])
    _, i, j = np.intersect1d(a[:, 0], b[:, 0], return_indices=True)
    if not len(i):
        return 0.0
    places, tails = b[j[np.argsort(i)], 1], []
    for p in places.tolist():
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return len(tails) / len(union)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next larger doc_id (after the last: the first); rows with one doc_id follow
    each other by text, null doc_ids come last. A null text is empty; an empty text has an empty fingerprint, which
    is like another empty one (1) and unlike any other (0); a text of under eight code points is one
    anchor of each scale. An only
    document is its own next. No rows give no rows. Other columns are not read.

    One shuffle deals the texts into ranges of doc_id; the first row of a range goes to the range before it too."""
    spark = common.bound_batches(docs.sparkSession)
    largest = 2**63 - 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.null_as_empty("text").alias("text"))
    order = F.coalesce("doc_id", F.lit(largest))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(largest)).alias("_order"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = sorted(set(ids.approxQuantile("_order", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    if not cuts and ids.isEmpty():
        return spark.createDataFrame([], _OUT)
    bounds = np.minimum(np.asarray(cuts, np.float64), 2.0**62).astype(np.int64)  # one number a partition
    edges = spark.sparkContext.broadcast(bounds)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(edges.value, batch.column("_order").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column("_order")], names=["_part", "_order"])

    firsts = {r["_part"]: r["_first"] for r in ids.mapInArrow(places, "_part int, _order long").groupBy("_part").agg(F.min("_order").alias("_first")).collect()}
    used = sorted(firsts)
    rank = {p: k for k, p in enumerate(used)}
    # where the first row of a range also goes: the range before it, and from the first range the last one
    mapping = spark.sparkContext.broadcast(({firsts[p]: (rank[p] - 1) % len(used) for p in used}, rank))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ranks = mapping.value
        for batch in batches:
            order = batch.column("_order").to_numpy()
            part = np.array([ranks[p] for p in np.searchsorted(edges.value, order, "right").tolist()], np.int32)
            extra = np.array([k for k, v in enumerate(order.tolist()) if v in before], np.int64)
            rows = pa.concat_tables([pa.Table.from_batches([batch]), pa.Table.from_batches([batch]).take(extra)])
            copy = np.concatenate([np.zeros(len(order), np.int32), np.ones(len(extra), np.int32)])
            to = np.concatenate([part, np.array([before[v] for v in order[extra].tolist()], np.int32)]).astype(np.int32)
            yield from rows.append_column("_copy", pa.array(copy)).append_column("_part", pa.array(to)).to_batches()

    dealt = rows.withColumn("_order", order).mapInArrow(deal, "doc_id long, text string, _order long, _copy int, _part int")
    dealt = dealt.repartitionById(len(used), F.col("_part")).sortWithinPartitions("_part", "_copy", "_order", "text")
    return dealt.mapInArrow(_edit_rows, _OUT)


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range: first its own by order, then the copy (or, for equal doc_ids, copies) that follow its last."""
    names = [c.split()[0] for c in _OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns: list[list] = [[] for _ in names]
    last = None  # (doc_id, text, sketch, part)

    def put(row, text: str, sk: np.ndarray) -> None:
        changed = edited(row[1], text)
        other = sketch(points_of(changed))
        for column, value in zip(columns, (row[0], len(row[1]), hashlib.sha256(changed.encode()).hexdigest(), pack(row[2]), pack(other), likeness(row[2], other), likeness(row[2], sk)), strict=True):
            column.append(value)

    for batch in (piece for whole in batches for piece in common.slices(whole, "text", 4 << 20)):
        for doc, text, copy, part in zip(*(batch.column(c) for c in ("doc_id", "text", "_copy", "_part")), strict=True):
            copy, part, text = copy.as_py(), part.as_py(), text.as_py()
            sk = sketch(points_of(text))
            if last is not None and last[3] == part:
                put(last, text, sk)
            last = (doc.as_py(), text, sk, part) if copy == 0 else None
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            columns = [[] for _ in names]
