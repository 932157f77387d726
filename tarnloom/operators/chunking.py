"""Cutting files into chunks of lines.

The window that starts at a line ends at the last line that fits both limits, moved back to a blank line or a line
that is indented no deeper than the window's first, or forward to the end of an open triple-quoted string. Where a
window ends depends on where the one before it ended, so a file is one loop; files are independent rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnloom import schema
from tarnloom.functions import text
from tarnloom.operators.definitions import READERS, Definition

MAX_LINES, MAX_CHARS, MIN_LINES, OVERLAP = 150, 6000, 3, 5
SMALL_FILE = 30
LOOK_BACK, LOOK_AHEAD, SLACK, INDENT_LINES = 10, 30, 20, 5
MAX_DOCSTRING, MAX_IMPORTS = 200, 10
QUOTES = ('"""', "'''")


@dataclass
class Piece:
    """Lines start..end (from 1) of a file and what is known about them."""

    start: int
    end: int
    content: str
    name: str | None = None
    kind: str | None = None
    parents: list[str] = field(default_factory=list)
    docstring: str | None = None
    imports: str | None = None


class Lines:
    """A file's lines with what the window search asks of them, computed once."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.ends = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])  # characters with line breaks
        self.indent = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]  # -1: blank
        quotes = np.array([[x.count(q) for q in QUOTES] for x in lines], np.int64).reshape(-1, 2)
        self.quotes = np.concatenate([np.zeros((1, 2), np.int64), quotes.cumsum(0)])
        self.quoted = np.flatnonzero(quotes.any(1))

    def fit(self, start: int, max_lines: int, max_chars: int) -> int:
        """One past the last line of a window from start that keeps the limits; a line at least."""
        by_chars = int(np.searchsorted(self.ends, self.ends[start] + max_chars, "right")) - 1
        return max(start + 1, min(start + max_lines, len(self.lines), by_chars))

    def boundary(self, start: int, end: int, max_lines: int) -> int:
        """Where a window from start that could end at `end` should end."""
        n = len(self.lines)
        if end >= n:
            return n
        if ((self.quotes[end] - self.quotes[start]) % 2).any():
            at = int(np.searchsorted(self.quoted, end))
            if at < len(self.quoted) and (close := int(self.quoted[at])) < min(end + LOOK_AHEAD, start + max_lines + SLACK) and close:
                return close + 1
        base = next((i for i in self.indent[start : start + INDENT_LINES] if i >= 0), None)
        for cut in range(end, max(start, end - min(LOOK_BACK, end - start)), -1):
            if self.indent[cut - 1] < 0 or base is None or self.indent[cut] <= base:
                return cut
        return end

    def windows(self, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
        """(start, end) of the windows from the first line to the last; each begins `overlap` lines before the end of
        the one before it, but a line further on at least."""
        start, n = 0, len(self.lines)
        while start < n:
            end = self.boundary(start, self.fit(start, max_lines, max_chars), max_lines)
            yield start, end
            if end >= n:
                return
            start = max(end - overlap, start + 1)


def chunk_lines(content: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[Piece]:
    """Chunks of any text: one if it keeps both limits (an empty one too: lines 1 to 0), else windows."""
    lines = content.splitlines()
    if len(lines) <= max_lines and len(content) <= max_chars:
        return [Piece(1, len(lines), content)]
    return [Piece(a + 1, b, "\n".join(lines[a:b])) for a, b in Lines(lines).windows(max_lines, max_chars, overlap)]


# ---------------------------------------------------------------- syntax-aware chunks


def _symbols(found: list[Definition], parents: list[str], lines: list[str]) -> Iterator[tuple[Definition, list[str]]]:
    """Definitions of three lines or more, outermost first; those within the limits (here in bytes) are not looked into."""
    for d in found:
        if d.last - d.first + 1 >= MIN_LINES:
            yield d, parents
            if d.last - d.first + 1 <= MAX_LINES and len("\n".join(lines[d.first - 1 : d.last]).encode()) <= MAX_CHARS:
                continue
        yield from _symbols(d.inner, [*parents, d.name] if d.encloses else parents, lines)


def is_meaningful(lines: list[str]) -> bool:
    """Two lines at least that are neither blank nor comments."""
    return sum(bool(s) and not s.startswith("#") for s in map(str.strip, lines)) >= 2


def chunk_source(content: str, language: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> list[Piece]:
    """Chunks of source code along its definitions; raises SyntaxError (or ValueError) where it does not parse.

    A file of few lines is one chunk. A definition within both limits is a chunk with its name, kind, enclosing
    classes, docstring and the file's first imports; a larger one is cut into windows that keep the enclosing names, but
    a decorated one is a chunk from behind its decorators to its end, however large.
    What lies between definitions becomes chunks of its own if it says anything."""
    lines = content.splitlines()
    if len(lines) <= SMALL_FILE:
        return [Piece(1, len(lines), content)]
    definitions, found = READERS[language](content, lines)
    imports = "\n".join(found[:MAX_IMPORTS]) or None
    covered = np.zeros(len(lines) + 1, bool)
    covered[-1] = True
    out = []
    for d, parents in _symbols(definitions, [], lines):
        a, b = d.first - 1, d.last
        if covered[a:b].all():
            continue
        covered[a:b] = True
        part, doc = "\n".join(lines[a:b]), d.docstring[:MAX_DOCSTRING] if d.docstring else None
        if b - a <= max_lines and len(part) <= max_chars:
            out.append(Piece(a + 1, b, part, d.name, d.kind, parents, doc, imports))
        elif d.main and b - d.main + 1 >= MIN_LINES:  # what is decorated stays whole
            out.append(Piece(d.main, b, "\n".join(lines[d.main - 1 : b]), d.name, d.main_kind, parents, doc, imports))
        else:
            inner = [*parents, d.name] if d.encloses else parents
            out += [Piece(a + 1 + s, a + e, "\n".join(lines[a + s : a + e]), parents=inner, imports=imports) for s, e in Lines(lines[a:b]).windows(max_lines, max_chars)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], covered]).astype(int)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if is_meaningful(lines[a:b]):
            out.append(Piece(int(a) + 1, int(b), "\n".join(lines[a:b])))
    return sorted(out, key=lambda p: p.start)


def chunk_file(path: str, content: str, language: str, syntax: bool = True, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> list[Piece]:
    """By syntax where it is known and asked for, else (and for source that does not parse) by lines."""
    if syntax and language in READERS:
        try:
            return chunk_source(content, language, max_lines, max_chars)
        except (SyntaxError, ValueError, RecursionError):
            pass
    return chunk_lines(content, max_lines, max_chars)


def chunk_files(files: DataFrame, syntax: bool = True, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """Chunks of files (path, content, optionally content_hash and collection). A null content is empty."""
    extra = [c for c in ("collection",) if c in files.columns]
    names = [f.name for f in schema.CHUNK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for row in zip(*(batch.column(c) for c in ("path", "content", "language", "content_hash", *extra)), strict=True):
                path, content, language, digest, *more = (x.as_py() for x in row)
                for p in chunk_file(path, content or "", language, syntax, max_lines, max_chars):
                    rows.append((path, p.start, p.end, p.content, language, p.name, p.kind, ".".join(p.parents) or None, p.parents, p.docstring, p.imports, digest, *more))
                held += len(content or "")
                if held > 8 << 20:
                    yield _batch(rows, names + extra)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names + extra)

    digest = F.col("content_hash") if "content_hash" in files.columns else F.lit(None).cast("string")
    rows = files.select("path", "content", text.language(F.col("path")).alias("language"), digest.alias("content_hash"), *extra)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.CHUNK)
    return rows.mapInArrow(run, ", ".join([fields, *(f"{c} string" for c in extra)]))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"start_line": pa.int32(), "end_line": pa.int32(), "parent_symbols": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
