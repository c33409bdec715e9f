"""Embed chunk texts in batches of 20 inside the tasks that hold them."""
from __future__ import annotations

import hashlib
import logging
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treelode.functions.batches import slices

# Fixed values of the workload.
DIMENSIONS = 1536
BATCH = 20
log = logging.getLogger(__name__)


class Embedder(Protocol):
    """Anything that turns texts into vectors; it is sent to the tasks, so it must pickle."""

    dimensions: int

    def ready(self) -> None:
        """Raise if the embedder cannot work, for instance without its key."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """One vector per text, in order."""


@lru_cache(maxsize=1 << 17)
def _hashed(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


class HashingEmbedder:
    """Counts words by hashed position, scaled to length one.

    Needs no network and always gives the same vector for a text. It knows words, not meanings; pass an
    embedder of your own for semantic search.
    """

    _word = re.compile(r"[a-z0-9_]+")

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def ready(self) -> None:
        return None

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        """A row per text, in one block."""
        block = np.zeros((len(texts), self.dimensions), np.float64)
        for row, text in zip(block, texts):
            counts = Counter(self._word.findall(text.lower()))
            places = np.fromiter((_hashed(word) % self.dimensions for word in counts), np.int64, len(counts))
            np.add.at(row, places, np.fromiter(counts.values(), np.float64, len(counts)))
        norms = np.linalg.norm(block, axis=1, keepdims=True)
        return np.divide(block, norms, out=block, where=norms > 0)


def checked(embedder: Embedder, texts: Sequence[str]) -> list[list[float]]:
    """Embed and refuse a short or misshapen answer."""
    vectors = embedder.embed(texts)
    if len(vectors) != len(texts) or any(len(v) != embedder.dimensions for v in vectors):
        raise ValueError("embedder returned a wrong number of vectors or dimensions")
    return vectors


def embed_or_reason(embedder: Embedder, texts: Sequence[str]) -> list[tuple[list[float] | None, str | None]]:
    """One call for the batch; if it fails, one retry per text; a text that fails again has the reason in place of a vector."""
    try:
        return [(vector, None) for vector in checked(embedder, texts)]
    except Exception:
        log.warning("a batch of %d texts was refused and is tried text by text", len(texts), exc_info=True)
    found: list[tuple[list[float] | None, str | None]] = []
    for text in texts:
        try:
            found.append((checked(embedder, [text])[0], None))
        except Exception as error:
            found.append((None, f"{type(error).__name__}: {error}"))
    return found


def embed_texts(embedder: Embedder, texts: Sequence[str]) -> list[list[float] | None]:
    """Vectors only; None for a text that was refused."""
    return [vector for vector, _ in embed_or_reason(embedder, texts)]


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """Add `vector` to every chunk, or null and the `reason` where embedding failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A vector is held in 64 and in 32 bits for a moment.
        for record in slices(batches, "content", 12 * embedder.dimensions):
            texts = record.column("content").to_pylist()
            found = [pair for n in range(0, len(texts), batch) for pair in embed_or_reason(embedder, texts[n:n + batch])]
            vectors = vector_column([vector for vector, _ in found], embedder.dimensions)
            reasons = pa.array([reason for _, reason in found], pa.string())
            yield pa.RecordBatch.from_arrays([*record.columns, vectors, reasons], [*record.schema.names, "vector", "reason"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields]
    return chunks.mapInArrow(run, ", ".join([*columns, "vector array<float>", "reason string"]))


def vector_column(vectors: Sequence, dimensions: int) -> pa.Array:
    """An Arrow column of 32-bit vectors, filled from one block; None stays null."""
    missing = np.fromiter((v is None for v in vectors), bool, len(vectors))
    block = np.array([v for v in vectors if v is not None], np.float32).reshape(-1)
    ends = np.concatenate(([0], np.cumsum(np.where(missing, 0, dimensions)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(block), mask=pa.array(missing))
