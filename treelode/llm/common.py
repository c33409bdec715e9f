"""What the operators share: the folder that all machines see, reliable cuts of lineage, and batches of bounded size."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.functions.batches import slices  # noqa: F401
from treelode.session import shared_folder


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def mounted(folder: str) -> str:
    """The path by which Python opens files in the shared folder; needs a folder that every machine has mounted."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {folder}")
    return parts.path


def settled(frame: DataFrame) -> DataFrame:
    """Compute a frame that several branches read, once, into the shared folder; it outlives lost executors."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def stored(frame: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """As settled(), but as a Parquet table: compressed, and read column by column."""
    spark, folder = frame.sparkSession, new_folder(frame.sparkSession, what)
    frame.write.parquet(folder, compression=codec)
    return spark.read.schema(frame.schema).parquet(folder)


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def texts_of(batch: pa.RecordBatch, column: str | int = "text") -> list[str]:
    return ["" if text is None else text for text in batch.column(column).to_pylist()]


def map_whole_rows(docs: DataFrame, start: Callable[[], Callable[[pa.RecordBatch, int], pa.RecordBatch]]) -> DataFrame:
    """Rows of a frame with all their columns, of any name, changed in Arrow batches.

    Each task calls `start` once and what it returns with each batch and the place of `text` in it.
    """
    names = docs.columns
    place = names.index("text")
    plain = docs.toDF(*[f"c{n}" for n in range(len(names))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = start()
        for batch in slices(batches, f"c{place}"):
            yield change(batch, place)

    return plain.mapInArrow(rows, plain.schema).toDF(*names)
