"""Nearest chunks to a query vector: exact scan, top-k by distance, ranked projections."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelode.functions import text as X
from treelode.functions.vectors import matrix_of, squared_gaps

OVERFETCH = 3
# Distance alone does not order copies of a vector; these columns do.
TIE_BREAK = ("file_path", "line_start", "id")
ORDER = ("_distance", *TIE_BREAK)


def is_code() -> Column:
    return F.col("chunk_type") != "doc_section"


def is_doc() -> Column:
    return F.col("chunk_type") == "doc_section"


def nearest(table: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """The `limit` rows with the smallest distance, without their vector.

    Each task passes on only its own best rows, and one merge picks among those.
    """
    return _task_best(table, [(0, query)], limit).drop("query_id").orderBy(*ORDER).limit(limit)


def fetch_size(limit: int, extensions: Sequence[str] | None) -> int:
    return limit * OVERFETCH if extensions else limit


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Suffix test; a missing leading dot is added."""
    dotted = [e if e.startswith(".") else f".{e}" for e in extensions]
    return reduce(lambda a, b: a | b, [path.endswith(e) for e in dotted])


def keep_extensions(found: DataFrame, extensions: Sequence[str] | None, limit: int) -> DataFrame:
    """Post-filter above the top-k. It can leave fewer than `limit` rows; see `nearest_with_extension`."""
    if not extensions:
        return found
    return found.where(has_extension(F.col("file_path"), extensions)).orderBy(*ORDER).limit(limit)


def nearest_with_extension(table: DataFrame, query: Sequence[float], limit: int,
                           extensions: Sequence[str] | None, exact: bool = False) -> DataFrame:
    """Top-k under an extension filter: over-fetch then filter, or with `exact` filter first."""
    if extensions and exact:
        return nearest(table.where(has_extension(F.col("file_path"), extensions)), query, limit)
    return keep_extensions(nearest(table, query, fetch_size(limit, extensions)), extensions, limit)


def ranked(found: DataFrame) -> DataFrame:
    """Number the few rows that are left. One task is enough: the limit bounds them."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*ORDER)))


def _common(found: DataFrame) -> dict[str, Column]:
    return {"lines": X.line_label(F.col("line_start"), F.col("line_end")), "score": X.score_of(F.col("_distance"))}


def code_results(found: DataFrame) -> DataFrame:
    """rank, file, name, type, lines, score, preview."""
    shared = _common(found)
    return ranked(found).select(
        "rank", F.col("file_path").alias("file"), "name", F.col("chunk_type").alias("type"),
        shared["lines"].alias("lines"), shared["score"].alias("score"),
        X.preview_of(F.col("content")).alias("preview"))


def doc_results(found: DataFrame) -> DataFrame:
    """rank, file, section, lines, score, content."""
    shared = _common(found)
    return ranked(found).select(
        "rank", F.col("file_path").alias("file"), F.col("name").alias("section"),
        shared["lines"].alias("lines"), shared["score"].alias("score"), "content")


def _task_best(table: DataFrame, block: Sequence[tuple[int, Sequence[float]]], limit: int) -> DataFrame:
    """The best `limit` rows per query of every task, with query_id and _distance."""
    ids = [int(i) for i, _ in block]
    targets = np.asarray([q for _, q in block], dtype=np.float64)
    kept_columns = [c for c in table.columns if c != "vector"]
    order = [(name, "ascending") for name in ("query_id", *ORDER)]

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        query = rows["query_id"].to_numpy()
        first = np.searchsorted(query, query, side="left")
        return rows.filter(pa.array(np.arange(len(query)) - first < limit))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows == 0 or limit < 1:
                continue
            vectors = matrix_of(batch.column("vector"), targets.shape[1])
            others = pa.Table.from_batches([batch.select(kept_columns)])
            found = [] if kept is None else [kept]
            for at, query_id in enumerate(ids):
                far = squared_gaps(vectors, targets[at])
                near = np.arange(len(far))
                if len(far) > limit:  # rows beyond the k-th distance cannot be among the best
                    near = np.flatnonzero(far <= np.partition(far, limit - 1)[limit - 1])
                part = others.take(pa.array(near))
                part = part.append_column("query_id", pa.array(np.full(len(near), query_id, np.int64)))
                found.append(part.append_column("_distance", pa.array(far[near])))
            kept = best(pa.concat_tables(found))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    kinds = {field.name: field.dataType.simpleString() for field in table.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept_columns] + ["query_id bigint", "_distance double"])
    return table.mapInArrow(scan, schema)
