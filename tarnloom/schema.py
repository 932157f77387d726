"""Row types of the engine: files go in, chunks are stored and found."""

from __future__ import annotations

from pyspark.sql import types as T

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("content_hash", T.StringType())])

CHUNK = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("symbol_name", T.StringType()),
        T.StructField("symbol_type", T.StringType()),
        T.StructField("parent_context", T.StringType()),
        T.StructField("parent_symbols", T.ArrayType(T.StringType())),
        T.StructField("docstring", T.StringType()),
        T.StructField("imports_context", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)

REQUEST = T.StructType([T.StructField("files", T.ArrayType(FILE)), T.StructField("collection", T.StringType()), T.StructField("deleted_files", T.ArrayType(T.StringType()))])

DEFAULT_COLLECTION = "default"
