"""Explicit schemas. Nothing in this package infers a schema from data."""
from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType(), False)

FILES = T.StructType([
    T.StructField("absolute_path", T.StringType(), False),
    T.StructField("relative_path", T.StringType(), False),
])

STATEMENTS = T.ArrayType(T.StructType([
    T.StructField("head", T.StringType(), False),
    T.StructField("row_start", T.IntegerType(), False),
    T.StructField("row_end", T.IntegerType(), False),
]))

CHUNKS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("chunk_type", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("line_start", T.IntegerType(), False),
    T.StructField("line_end", T.IntegerType(), False),
])

# `hash` is the digest of the file text a chunk was cut from; the state rows are derived from it.
# `reason` says why a chunk has no vector.
STORED_CHUNKS = T.StructType(CHUNKS.fields + [
    T.StructField("hash", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False), True),
    T.StructField("reason", T.StringType(), True),
])

META = T.StructType([
    T.StructField("relative_path", T.StringType(), False),
    T.StructField("hash", T.StringType(), False),
    T.StructField("chunk_ids", STRINGS, False),
    T.StructField("last_indexed", T.TimestampType(), False),
])

CHUNK_TYPES = (
    "function", "component", "hook", "class", "type", "export", "module", "doc_section",
    "method", "struct", "trait", "impl", "rule", "element",
)
