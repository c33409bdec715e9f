"""Vector distance as an Arrow function: only the vector column travels to Python and back."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


BLOCK_NUMBERS = 1 << 16


def matrix_of(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, a view of the Arrow buffer."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if flat.size != len(vectors) * width:
        raise ValueError(f"every vector must have {width} numbers")
    return flat.reshape(len(vectors), width)


def squared_gaps(vectors: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every row to `target`, in double precision.

    Rows are widened a block at a time, so the doubles stay in the processor cache.
    """
    out = np.empty(len(vectors))
    step = max(1, BLOCK_NUMBERS // target.size)
    for at in range(0, len(vectors), step):
        gap = vectors[at:at + step] - target
        out[at:at + step] = np.einsum("ij,ij->i", gap, gap)
    return out


def squared_l2(vector: Column, query: Sequence[float]) -> Column:
    """Squared distance to one query vector, for every row."""
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        return pa.array(squared_gaps(matrix_of(vectors, target.size), target))

    return distance(vector)
