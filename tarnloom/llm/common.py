"""What the operators of this subpackage share: work tables, Arrow plumbing and vectorised text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but these; A-Z is folded where an operator says so.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- work tables


def work_root(spark: SparkSession) -> str:
    """The shared folder for work tables: spark.checkpoint.dir; where unset (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tarnloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below work_root; the JVM deletes it when it ends."""
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stash(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes df as a work table and returns the table: it cuts the lineage and outlives lost executors. A small one
    (a few bytes for each of some of the documents) gets no more files than there are cores."""
    spark = df.sparkSession
    df = df.coalesce(spark.sparkContext.defaultParallelism) if small else df
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a work table that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes that Spark hands to a Python task at once; a longer row stands alone.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, as rows differ in size by orders of magnitude; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


# ---------------------------------------------------------------- columns


def null_as_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % n


# ---------------------------------------------------------------- Arrow


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about limit bytes together (a longer text stands alone)."""
    offsets = text_buffers(batch.column(column))[1]
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, without copying; nulls must have been replaced."""
    wide = pa.types.is_large_string(texts.type)
    if not (wide or pa.types.is_string(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    _, ends, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---------------------------------------------------------------- hashing

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Which bytes are part of a word, and of a word of letters only (bytes of multi-byte characters count as letters).
SOLID = ~_SPACE
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_RUN = 1 << 14
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20 | 1 << 12)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of many texts: start and end (byte positions), doc (index of the text) and hash (64 bits)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, within: np.ndarray = SOLID):
        n = len(data)
        solid = (data != 32) & (data - np.uint8(9) > 4) if within is SOLID else within.take(data)
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = solid[begins]
        closes = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[closes] = solid[closes]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._counts = np.diff(np.searchsorted(self.start, offsets))
        self.doc = np.repeat(np.arange(len(offsets) - 1), self._counts)
        up, down = powers(n + 1)
        sums, values = np.zeros(n + 1, np.uint64), _FOLDED if fold else _BYTE
        for a in range(0, n, _RUN):  # what is added stays in the processor's cache
            some = values.take(data[a : a + _RUN])
            some *= up[a : a + len(some)]
            some[:1] += sums[a : a + 1]
            np.cumsum(some, out=sums[a + 1 : a + 1 + len(some)])
        self._sums, self._down = sums, down
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix64(raw ^ (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.n_docs = len(offsets) - 1

    def affix(self, n: int, front: bool, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the first or last n bytes of each word (all of a shorter one), or of those at some places."""
        start, end = self.start[at], self.end[at]
        a, b = (start, np.minimum(start + n, end)) if front else (np.maximum(end - n, start), end)
        return mix64((self._sums[b] - self._sums[a]) * self._down[a] + np.uint64(n * 2 + front))

    def counts(self) -> np.ndarray:
        return self._counts


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 values as Spark longs."""
    return x.view(np.int64)
