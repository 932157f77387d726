"""Embedding texts: any model with a vectorised call, and a hashed one that needs no download."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnloom.functions import text

#: Characters that go to a model at once, and how often a failing call is tried.
BATCH_CHARS, ATTEMPTS = 20_000, 3


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Counts of words and their character trigrams, hashed with a sign into a vector of unit length."""

    def __init__(self, dimension: int = 768):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, words in zip(out, (re.findall(r"\w+", t.lower()) for t in texts), strict=True):
            for word in words:
                for feature, weight in [(word, 1.0), *((f"#{word[k : k + 3]}", 0.5) for k in range(len(word) - 2))]:
                    h = zlib.crc32(feature.encode())
                    row[(h >> 1) % self.dimension] += weight if h & 1 else -weight
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def batches_of(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Runs of texts of at most `limit` characters together; a longer one stands alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def embed_all(embedder: Embedder, texts: list[str], attempts: int = ATTEMPTS) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text. A run that keeps failing is tried text by text, so that one bad text costs only itself."""

    def call(part: list[str]) -> list:
        for k in range(attempts):
            try:
                return [(v.astype(np.float32).tolist(), None) for v in np.asarray(embedder.embed(part))]
            except Exception as error:  # noqa: BLE001  whatever a model raises becomes the row's error
                if k == attempts - 1:
                    return [(None, str(error))] if len(part) == 1 else [x for t in part for x in call([t])]
        return []

    return [x for part in batches_of(texts) for x in call(part)]


def embed(rows: DataFrame, embedder: Embedder, column: str = "content", task: str = "search_document", model: str = "nomic-embed-text") -> DataFrame:
    """rows with embedding and embed_error (one of them null), of the column's text behind the model's prefix for the
    task. A null text has neither."""
    names = rows.columns
    shared = rows.sparkSession.sparkContext.broadcast(embedder)
    asked = rows.withColumn("_text", text.task_text(F.col(column), task, model))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            real = [k for k, t in enumerate(texts) if t is not None]
            found: list = [(None, None)] * len(texts)
            for k, pair in zip(real, embed_all(shared.value, [texts[k] for k in real]), strict=True):
                found[k] = pair
            extra = [pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *extra], names=[*names, "embedding", "embed_error"])

    return asked.mapInArrow(run, f"{fields}, embedding array<float>, embed_error string")


class EmbeddingError(RuntimeError):
    """A model failed on texts that had to be embedded."""


def embed_documents(embedder: Embedder, texts: list[str], model: str = "nomic-embed-text", raise_on_error: bool = True) -> list[list[float] | None]:
    """The vectors of a few texts, each behind the model's prefix; where the model fails an EmbeddingError, or, without
    raise_on_error, None."""
    prefix = text.TASK_PREFIXES.get(model, {}).get("search_document", "")
    found = embed_all(embedder, [prefix + t[: text.MAX_EMBED_CHARS] for t in texts])
    if raise_on_error and (failed := [(k, e) for k, (v, e) in enumerate(found) if v is None]):
        raise EmbeddingError(f"{len(failed)} of {len(texts)} texts failed, the first at {failed[0][0]}: {failed[0][1]}")
    return [v for v, _ in found]


def embed_query(embedder: Embedder, query: str, model: str = "nomic-embed-text", raise_on_error: bool = False) -> list[float] | None:
    """The vector of one query; if the model fails None, or, with raise_on_error, an EmbeddingError."""
    prefix = text.TASK_PREFIXES.get(model, {}).get("search_query", "")
    vector, error = embed_all(embedder, [prefix + query[: text.MAX_EMBED_CHARS]])[0]
    if vector is None and raise_on_error:
        raise EmbeddingError(error)
    return vector
