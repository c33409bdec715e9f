"""Arrow batches cut to a bounded size, so that a Python worker holds few texts as objects however many rows Spark sends at once."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
"""Text that a Python worker holds as objects at a time; a larger one makes a slice of its own."""


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", row_bytes: int = 0) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts, and `row_bytes` more for each row, take about SLICE_BYTES at most."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            size += row_bytes
            if held and held + size > SLICE_BYTES:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
