"""Media columns: chroma audio fingerprints and their alignment.

A recording is 16-bit little-endian mono PCM. Its spectrum's power is folded into twelve pitch classes a frame; box
filters, summed from an integral image over frames and classes, each give two bits, and sixteen filters one 32-bit
integer a frame. Two recordings share integers at one offset if they hold the same sound: a histogram of the offsets
of equal integers finds it, and the share of differing bits over the overlap decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

RATE, FRAME, HOP = 2048, 256, 64
LOWEST, HIGHEST, BASE = 190.0, 880.0, 220.0
#: Frames that a filter spans at most; a recording gives an integer for each run of so many frames.
SPAN = 16
_LIMIT = 0.35
#: Alignments count with a share of differing bits up to this and an overlap of so many integers.
MOST_ERRORS, LEAST_OVERLAP = 0.30, 48


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) power by pitch class, each frame summing to 1 (or 0 if silent)."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if n == 0:
        return np.zeros((0, 12))
    at = np.arange(n)[:, None] * HOP + np.arange(FRAME)
    power = np.abs(np.fft.rfft(samples[at] * np.hanning(FRAME), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((hertz >= LOWEST) & (hertz < HIGHEST))
    pitch = np.rint(12 * np.log2(hertz[used] / BASE)).astype(int) % 12
    out = power[:, used] @ (pitch[:, None] == np.arange(12))
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 0)


def _box(integral: np.ndarray, t0: int, t1: int, y0: int, y1: int, n: int) -> np.ndarray:
    return integral[t1 : t1 + n, y1] - integral[t0 : t0 + n, y1] - integral[t1 : t1 + n, y0] + integral[t0 : t0 + n, y0]


def integers(samples: np.ndarray) -> np.ndarray:
    """The packed filters of each run of SPAN frames (uint32); none for less than one run."""
    c = chroma(samples)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(c) + 1, 13))
    integral[1:, 1:] = c.cumsum(0).cumsum(1)
    out = np.zeros(n, np.uint32)
    for k in range(16):
        width, height = 4 * (1 + k // 4), 2 + 2 * (k % 5)
        low = (5 * k) % (13 - height)
        high, mid, half = low + height, low + height // 2, width // 2
        box = lambda a, b, y, z: _box(integral, a, b, y, z, n)
        if k % 4 == 0:
            a, b = box(0, width, low, high), box(0, width, 0, 12) - box(0, width, low, high)
        elif k % 4 == 1:
            a, b = box(0, width, low, mid), box(0, width, mid, high)
        elif k % 4 == 2:
            a, b = box(0, half, low, high), box(half, width, low, high)
        else:
            a, b = box(0, half, low, mid) + box(half, width, mid, high), box(half, width, low, mid) + box(0, half, mid, high)
        level = np.digitize(np.log((0.5 + a) / (0.5 + b)), (-_LIMIT, 0.0, _LIMIT))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def samples_of(pcm: bytes | None) -> np.ndarray:
    """A null or odd-sized recording loses what is no whole sample."""
    pcm = pcm or b""
    return np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(np.float32) / 32768


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(id, ints): the packed integers (uint32, little-endian) of each recording (id, pcm)."""
    common.bound_batches(recordings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [integers(samples_of(p.as_py())).astype("<u4").tobytes() for p in batch.column("pcm")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "ints"])

    return recordings.select(F.col("id").cast("long").alias("id"), "pcm").mapInArrow(run, "id long, ints binary")


def _postings(prints: DataFrame, name: str) -> DataFrame:
    """(key, name, at) of each integer, one row for its first place in a run of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, places = [], [], []
            for id_, raw in zip(batch.column("id"), batch.column("ints"), strict=True):
                x = np.frombuffer(raw.as_buffer(), "<u4")
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
                keys.append(x[first].astype(np.int64))
                places.append(first.astype(np.int32))
                ids.append(np.full(len(first), id_.as_py(), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, places)], names=["key", name, "at"])

    return prints.select("id", "ints").mapInArrow(run, f"key long, {name} long, at int")


def overlap_error(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, length) of the overlap where y[i + offset] stands by x[i]."""
    a, b = max(0, -offset), min(len(x), len(y) - offset)
    if b <= a:
        return 1.0, 0
    return float(np.bitwise_count(x[a:b] ^ y[a + offset : b + offset]).sum()) / (32 * (b - a)), b - a


def align(queries: DataFrame, prints: DataFrame) -> DataFrame:
    """(query, id, offset, bit_error) of the recordings (id, ints) that hold a query (id, ints), at the offset where
    the most integers are equal (the smaller of ties), one row a pair. Silence, which all recordings share, is one
    integer and one posting a run, so it alone never aligns two recordings: three offsets must agree."""
    hits = _postings(queries, "query").withColumnRenamed("at", "_q").join(_postings(prints, "id"), "key")
    votes = hits.groupBy("query", "id", (F.col("at") - F.col("_q")).alias("offset")).agg(F.count("*").alias("votes")).where("votes >= 3")
    best = votes.groupBy("query", "id").agg(F.max_by("offset", F.struct("votes", -F.col("offset"))).alias("offset"))
    rows = best.join(queries.select(F.col("id").alias("query"), F.col("ints").alias("_x")), "query").join(prints.select("id", F.col("ints").alias("_y")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [overlap_error(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), o) for x, y, o in zip(batch.column("_x"), batch.column("_y"), batch.column("offset").to_pylist(), strict=True)]
            keep = pa.array([n >= LEAST_OVERLAP and e <= MOST_ERRORS for e, n in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), batch.column("offset"), pa.array([e for e, _ in found], pa.float64())], names=["query", "id", "offset", "bit_error"]).filter(keep)

    return rows.select("query", "id", "offset", "_x", "_y").mapInArrow(run, "query long, id long, offset int, bit_error double")


# ---------------------------------------------------------------- recordings from vectors


def melody(vector: list[float] | np.ndarray, start: int = 0, gain: float = 0.6, note: int = 2 * HOP) -> bytes:
    """A recording of one tone a component, its pitch by the component's value, from sample `start` on."""
    v = np.nan_to_num(np.asarray([0.0 if x is None else x for x in vector], np.float64), posinf=0, neginf=0)
    hertz = np.repeat(BASE * 2 ** ((np.floor(v * 48) % 12) / 12), note)
    wave = np.sin(2 * np.pi * np.cumsum(hertz) / RATE)[start:]
    return (wave * gain * 32767).astype("<i2").tobytes()


def _of_vectors(vectors: DataFrame, start: int = 0, gain: float = 0.6) -> DataFrame:
    """fingerprints() of the recordings of vectors (vec_id, embedding), which are made where they are read and never
    leave the task; a null vector is an empty recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [integers(samples_of(melody(v, start, gain) if v is not None else b"")).astype("<u4").tobytes() for v in part.column("v").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.binary())], names=["id", "ints"])

    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).mapInArrow(run, "id long, ints binary")


def search(vectors: DataFrame, every: int = 100, start: int = 10 * HOP + 17, gain: float = 0.3) -> DataFrame:
    """A row per recording: vec_id, n_ints, class_id (the smallest vec_id with the same fingerprint) and matches:
    (query_id, offset, bit_error) of the excerpts found in it, by query_id.

    Queries are quieter excerpts, cut beside the frames' grid, of the recordings whose vec_id is divisible by
    `every`; of queries with one class, the smallest vec_id stands for all, and classes are searched rather than
    their members, so a group of copies adds rows in proportion to its size. A null or short vector gives a
    recording without integers: its class is its own vec_id and it matches nothing. Null vec_ids keep null classes
    if their sound is unique. Rows repeat as they come; no rows give no rows; other columns are not read."""
    common.bound_batches(vectors.sparkSession)
    prints = common.stash(_of_vectors(vectors), "audio-prints")
    classes = common.stash(prints.where(F.length("ints") > 0).groupBy("ints").agg(F.min("id").alias("class_id"), F.min(F.when(F.col("id") % every == 0, F.col("id"))).alias("query")), "audio-classes")
    asked = vectors.join(classes.where("query is not null").select(F.col("query").alias("vec_id")), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    excerpts = common.stash(_of_vectors(asked, start, gain), "audio-excerpts")
    found = align(excerpts, classes.where("class_id is not null").select(F.col("class_id").alias("id"), "ints"))
    matches = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("query").alias("query_id"), "offset", "bit_error"))).alias("matches"))
    matched = common.stash(classes.select("ints", "class_id").join(matches.withColumnRenamed("id", "class_id"), "class_id", "left"), "audio-matched")
    out = prints.join(matched, "ints", "left")
    return out.select(
        F.col("id").alias("vec_id"),
        (F.length("ints") / 4).cast("long").alias("n_ints"),
        F.when(F.length("ints") == 0, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("matches", F.array().cast("array<struct<query_id:bigint,offset:int,bit_error:double>>")).alias("matches"),
    )
