"""Compare scanned files with the stored state."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detect_changes(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Add `change` to a full outer join on relative_path: added, modified, deleted or unchanged.

    Only paths and digests are shuffled; file contents never are.
    """
    # The state has one entry per path; grouping keeps it so and shares the shuffle of the join.
    state = meta.groupBy(F.col("relative_path").alias("stored_path")).agg(F.max("hash").alias("stored_hash"))
    joined = files.join(state, files["relative_path"] == state["stored_path"], "full_outer")
    change = (
        F.when(F.col("stored_path").isNull(), "added")
        .when(F.col("relative_path").isNull(), "deleted")
        .when(F.col("hash") != F.col("stored_hash"), "modified")
        .otherwise("unchanged")
    )
    kept = [c for c in files.columns if c != "relative_path"]
    return joined.select(F.coalesce("relative_path", "stored_path").alias("relative_path"), *kept, change.alias("change"))


def deleted_paths(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Stored paths that were not scanned."""
    return meta.join(files, "relative_path", "left_anti").select("relative_path")


def change_counts(changes: DataFrame, *more: Column) -> DataFrame:
    """One row: added, modified, deleted, total and any further aggregates."""
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")]
    return changes.agg(*counts, *more).withColumn("total", F.col("added") + F.col("modified") + F.col("deleted"))


def meta_rows(chunks: DataFrame) -> DataFrame:
    """State rows from stored chunks: one per file, its chunk ids in line order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_start", "line_end", "id")))
    return (
        chunks.groupBy(F.col("file_path").alias("relative_path"))
        .agg(F.first("hash").alias("hash"), ordered.alias("parts"))
        .select("relative_path", "hash", F.transform("parts", lambda p: p["id"]).alias("chunk_ids"),
                F.current_timestamp().alias("last_indexed"))
    )
