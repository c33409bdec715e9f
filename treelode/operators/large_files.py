"""Chunks of files too large for one row: lines numbered across the splits of a file, then windows and sections of lines.

Spark reads a large text in splits by several tasks. A line's number is its place in its split plus the lines of the splits before, a
prefix sum over one small row per split. Windows are groups of 200 numbers; sections are islands between headings, numbered by a
second prefix sum. Chunks equal those of chunking.py for the same text, ids included; only a chunk's own lines ever stand in one row.

Files are UTF-8 and not empty; a split ends where spark.sql.files.maxPartitionBytes says.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelode.functions import text as X
from treelode.operators.chunking import _file_header, _identified
from treelode.session import settle
from treelode.sources.project import root_uri


def numbered_lines(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """(file_path, split, n, line, total, heading) of some files below a root; lines are counted from 1."""
    base = root_uri(root)
    read = spark.read.option("lineSep", "\n").text([f"{base}/{path}" for path in paths])
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = read.select(F.substring_index(decoded, f"{base.partition(':')[2].lstrip('/')}/", -1).alias("file_path"), F.col("_metadata.file_block_start").alias("split"),
                        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    sizes = lines.groupBy("file_path", "split").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    sizes = settle(sizes)  # a row for each split
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    ends = F.sum("bytes").over(whole) == F.col("size")  # the last line ends in a line end, behind which an empty line stands
    placed = sizes.select("file_path", "split", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"),
                          (F.sum("lines").over(whole) + ends.cast("int")).alias("total"), ends.alias("ends"))
    within = F.row_number().over(Window.partitionBy("file_path", "split").orderBy("place"))
    numbered = lines.withColumn("within", within).join(placed, ["file_path", "split"]).select(
        "file_path", "split", (F.col("before") + F.col("within")).alias("n"), "line", "total")
    last = placed.where("ends").groupBy("file_path").agg(F.max("split").alias("split"), F.max("total").alias("total"))
    numbered = numbered.unionByName(last.select("file_path", "split", F.col("total").alias("n"), F.lit("").alias("line"), "total"))
    return numbered.withColumn("heading", (F.col("n") == 1) | X.is_heading(F.col("line")))


def _joined(lines: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Groups of lines with their text and ends."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda p: p["line"]), "\n")
    return lines.groupBy(*keys).agg(body.alias("body"), F.min("n").cast("int").alias("line_start"), F.max("n").cast("int").alias("line_end"), *more)


def _chunks(parts: DataFrame, hashes: DataFrame) -> DataFrame:
    part = F.struct("chunk_type", "name", "body", "line_start", "line_end").alias("part")
    return _identified(parts.join(hashes.select("file_path", "hash"), "file_path").select(
        "file_path", "hash", _file_header().alias("header"), F.col("ordinal").cast("int").alias("ordinal"), part))


def large_windows(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """Fixed windows, as chunk_windows. `hashes` has file_path and the digest of the whole text."""
    width = F.when(F.col("total") <= X.SMALL_FILE_LINES, F.col("total")).otherwise(X.WINDOW_LINES)
    parts = _joined(lines.withColumn("ordinal", F.floor((F.col("n") - 1) / width)), ["file_path", "ordinal", "total"])
    base = X.base_name(F.col("file_path"))
    label = F.concat(base, F.lit(":"), X.line_label(F.col("line_start"), F.col("line_end")))
    named = parts.withColumns({"chunk_type": F.lit("module"), "name": F.when(F.col("total") <= X.SMALL_FILE_LINES, base).otherwise(label)})
    return _chunks(named, hashes)


def large_sections(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """Heading sections, as chunk_headings."""
    opened = settle(lines.groupBy("file_path", "split").agg(F.count_if("heading").alias("opened")))
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    placed = opened.select("file_path", "split", F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("before"))
    running = F.count_if("heading").over(Window.partitionBy("file_path", "split").orderBy("n"))
    sections = lines.withColumn("running", running).join(placed, ["file_path", "split"]).withColumn("section", F.col("before") + F.col("running"))
    # Blank sections are dropped before the rest are counted; that needs no text.
    kept = sections.groupBy("file_path", "section").agg(F.max(X.js_trim(F.col("line")) != "").alias("some")).where("some")
    kept = kept.select("file_path", "section", (F.row_number().over(Window.partitionBy("file_path").orderBy("section")) - 1).alias("ordinal"))
    parts = _joined(sections, ["file_path", "section"], F.min_by("line", "n").alias("first")).join(kept, ["file_path", "section"])
    name = F.when(F.col("section") == 1, X.base_name(F.col("file_path"))).otherwise(X.heading_title(F.col("first")))
    return _chunks(parts.withColumns({"chunk_type": F.lit("doc_section"), "name": name, "body": X.js_trim(F.col("body"))}), hashes)
