"""Nearest rows for every row of a DataFrame of queries: a blocked matrix product with partial top-k states.

The table is packed into slices of about SLICE_ROWS vectors and every query is sent to every slice, so each block of
queries meets each slice once. A task holds one slice and streams queries past it. A matrix product bounds the distances; only
rows within rounding of the limit-th best are measured exactly, and only the best of a slice move on to be ranked. No vector passes
the driver, and the plan is the same for any number of queries.

Rows and queries without a vector take no part; queries that repeat query_id share one ranking.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelode.functions.vectors import matrix_of
from treelode.operators.search import ORDER

SLICE_ROWS, PACK_ROWS, QUERIES_AT_ONCE = 1 << 14, 1 << 11, 256
SQUARED, COSINE = "squared", "cosine"


def nearest_join(table: DataFrame, queries: DataFrame, limit: int, metric: str = SQUARED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """query_id, rank, _distance and the columns of `table` but `vector`, for each of `queries` (query_id, vector).

    `metric` is the squared Euclidean distance or one minus the cosine, which is 1 where a vector is all zeros.
    """
    if metric not in (SQUARED, COSINE):
        raise ValueError(f"metric must be {SQUARED} or {COSINE}, not {metric!r}")
    rows = table.where("vector is not null")
    slices = max(1, -(-rows.count() // slice_rows))
    held = _packed(rows, slices).select("slice", F.lit(0).alias("kind"), "pack")
    asked = queries.where("vector is not null").select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(1).alias("kind"), "query_id", "vector")
    met = held.unionByName(asked, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "kind")
    kept = [field for field in table.schema.fields if field.name != "vector"]
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", "_distance double",
                        *(f"`{field.name}` {field.dataType.simpleString()}" for field in kept)])
    found = met.mapInArrow(_scan(limit, metric), schema)
    window = Window.partitionBy("query_id").orderBy(*ORDER)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def _packed(rows: DataFrame, slices: int) -> DataFrame:
    """(slice, pack): Arrow streams of a few thousand rows, dealt in turn by every task, so that equal rows do not meet."""

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for start in range(0, batch.num_rows, PACK_ROWS):
                sink = pa.BufferOutputStream()
                part = pa.RecordBatch.from_arrays(batch.slice(start, PACK_ROWS).columns, names)
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([number % slices], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "pack"])
                number += 1

    names = rows.columns
    return rows.toDF(*[f"c{n}" for n in range(len(names))]).mapInArrow(packs, "slice int, pack binary")  # a name may hold a dot


class _Slice:
    """Rows of a slice, ready to be measured."""

    def __init__(self, packs: list[bytes], metric: str):
        rows = pa.concat_tables([pa.ipc.open_stream(pack).read_all() for pack in packs]).combine_chunks()
        vectors = rows.column("vector").combine_chunks()
        width = len(vectors[0])
        self.keys = rows.drop_columns(["vector"])
        self.vectors = _prepared(matrix_of(vectors, width), metric)
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.metric = metric

    def best(self, ids: pa.Array, targets: np.ndarray, limit: int) -> pa.Table:
        """The first `limit` rows for each target, with exact distances."""
        norms = np.einsum("ij,ij->i", targets, targets)
        near = self.norms - 2 * (targets @ self.vectors.T) + norms[:, None]
        if self.metric == COSINE:
            near[:, self.norms == 0] = near[norms == 0] = 2
        if near.shape[1] > limit:
            slack = (norms + self.norms.max())[:, None] * targets.shape[1] * 1e-14
            near = near <= np.partition(near, limit - 1, axis=1)[:, limit - 1, None] + slack
        else:
            near = np.ones_like(near, bool)
        query, row = np.nonzero(near)
        gap = self.vectors[row] - targets[query]
        distance = np.einsum("ij,ij->i", gap, gap)
        if self.metric == COSINE:
            distance = np.where((self.norms[row] == 0) | (norms[query] == 0), 1.0, distance / 2)
        found = self.keys.take(pa.array(row)).append_column("place", pa.array(query)).append_column("_distance", pa.array(distance))
        found = found.take(pc.sort_indices(found, sort_keys=[(name, "ascending") for name in ("place", *ORDER)]))
        place = found.column("place").to_numpy()
        found = found.filter(pa.array(np.arange(len(place)) - np.searchsorted(place, place) < limit))
        return found.append_column("query_id", ids.take(found.column("place").combine_chunks()))


def _prepared(vectors: np.ndarray, metric: str) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    if metric == COSINE:
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        vectors = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
    return vectors


def _scan(limit: int, metric: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packs, held = None, [], None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            slices = batch.column("slice").to_numpy()
            # A run is rows of one slice and kind; queries come after the packs of their slice.
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(slices) != 0) | (np.diff(kinds) != 0)))) if batch.num_rows else []
            for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                if slices[start] != current:
                    current, packs, held = slices[start], [], None
                part = batch.slice(start, stop - start)
                if kinds[start] == 0:
                    packs += part.column("pack").to_pylist()
                    continue
                if not packs or limit < 1:
                    continue
                held = held or _Slice(packs, metric)
                for first in range(0, part.num_rows, QUERIES_AT_ONCE):
                    some = part.slice(first, QUERIES_AT_ONCE)
                    targets = _prepared(matrix_of(some.column("vector"), held.vectors.shape[1]), metric)
                    found = held.best(some.column("query_id"), targets, limit)
                    yield from found.select(["query_id", "_distance", *held.keys.column_names]).combine_chunks().to_batches()

    return scan
