"""File tree and its statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelode.functions import text as X


def file_tree(files: DataFrame) -> DataFrame:
    """Rows of directory and file name in tree order.

    The sort key ends in the file name, so range partitioning also splits a directory that holds a
    large share of all files. Lists per directory are built only where one message is written.
    """
    path = F.col("relative_path")
    return files.select(X.dir_name(path).alias("dir"), X.base_name(path).alias("file")).orderBy("dir", "file")


def tree_stats(files: DataFrame) -> DataFrame:
    """One row: total_files, code_files, doc_files and the sorted distinct extensions.

    The extension set has at most as many members as there are supported extensions.
    """
    return files.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("category") == "code").alias("code_files"),
        F.count_if(F.col("category") == "docs").alias("doc_files"),
        F.array_sort(F.collect_set("extension")).alias("languages"),
    )


def directory_counts(files: DataFrame) -> DataFrame:
    """Number of files per directory, summed before the shuffle."""
    return files.groupBy(X.dir_name(F.col("relative_path")).alias("dir")).agg(F.count("*").alias("files"))


def category_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count("*").alias("files"))
