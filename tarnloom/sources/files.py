"""Where files come from: directories, JSON requests; and which of them are worth indexing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnloom import schema

# What indexing skips.
IGNORED_DIRS = (
    ".git", "build", "node_modules", ".gradle", ".venv", "venv", ".idea", "bin", "obj", "out", "metadata", ".metadata", ".next", "dist", "target", "__pycache__", ".vscode",
    ".pytest_cache", ".mypy_cache",
)
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".exe", ".dll", ".so", ".bin", ".jar", ".class", ".aar", ".xcf", ".svg", ".ttf", ".otf", ".woff", ".woff2", ".7z",
    ".tar", ".gz", ".dmg", ".iso", ".sqlite",
)
IGNORED_FILES = ("gradlew", "gradlew.bat", ".gitignore", "gradle.properties", "settings.gradle", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".DS_Store")


def in_ignored_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def is_ignored_file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*IGNORED_FILES)


def extension(path: Column) -> Column:
    """From the last dot of the name on, lower-cased; none where only dots come before it."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.].*?(\.[^.]*)$", 1))


def is_binary(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


def is_blank(content: Column) -> Column:
    return ~F.coalesce(content, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def worth_indexing(files: DataFrame) -> DataFrame:
    """Files (path, content) outside ignored folders, not ignored by name or as binary, and not blank."""
    path = F.col("path")
    return files.where((path != "") & ~in_ignored_dir(path) & ~is_ignored_file(path) & ~is_binary(path) & ~is_blank(F.col("content")))


def list_files(root: str) -> list[str]:
    """Paths below root, relative to it, without those in ignored folders, which are not entered."""
    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base, found, left = base.rstrip("/"), [], [base]
    while left:
        for info in store.get_file_info(fs.FileSelector(left.pop())):
            if info.type == fs.FileType.Directory:
                if info.base_name not in IGNORED_DIRS:
                    left.append(info.path)
            elif info.type == fs.FileType.File:
                found.append(info.path[len(base) + 1 :])
    return sorted(found)


def read_directory(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Files below root as (path relative to it, content, content_hash), UTF-8 with invalid bytes dropped.

    Spark's own file sources leave out names that begin with a dot or an underscore, __init__.py among them, so names
    are listed here and tasks open them, in any store that Arrow reads and all executors reach."""
    names = list_files(root)
    parts = partitions or max(1, min(len(names), spark.sparkContext.defaultParallelism * 4))
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    path = F.col("path")
    listed = listed.where(~in_ignored_dir(path) & ~is_ignored_file(path) & ~is_binary(path)).repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for name in batch.column("path").to_pylist():  # a file at a time bounds memory by the largest
                with store.open_input_stream(f"{base.rstrip('/')}/{name}") as f:
                    content = f.read().decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content])], names=["path", "content"])

    return listed.mapInArrow(run, "path string, content string").where(~is_blank(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))


def parse_requests(requests: DataFrame, column: str = "body") -> DataFrame:
    """JSON index requests as (collection, files, deleted_files); missing parts are empty, the collection the default."""
    body = F.from_json(column, schema.REQUEST)
    return requests.select(body.alias("_b")).select(
        F.coalesce("_b.collection", F.lit(schema.DEFAULT_COLLECTION)).alias("collection"),
        F.coalesce("_b.files", F.array().cast(schema.REQUEST["files"].dataType)).alias("files"),
        F.coalesce("_b.deleted_files", F.array().cast("array<string>")).alias("deleted_files"),
    )


def requested_files(parsed: DataFrame) -> DataFrame:
    """(collection, path, content, content_hash) of files that have a path and are not blank."""
    return parsed.select("collection", F.explode("files").alias("_f")).select("collection", "_f.*").where((F.col("path") != "") & ~is_blank(F.col("content")))
