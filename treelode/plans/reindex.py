"""Incremental indexing: scan, compare, chunk, embed, store."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treelode.operators.changes import change_counts, detect_changes
from treelode.operators.chunkers import Chunkers
from treelode.operators.chunking import chunk_files
from treelode.operators.embedding import Embedder, embed_chunks
from treelode.sources import project as P
from treelode.sources.store import ChunkStore
from treelode.sources.tree import read_tasks, scan_files, with_contents, with_hashes


@dataclass(frozen=True)
class Totals:
    """`chunks_created` counts chunks made, `chunks_embedded` those that were stored."""

    files_processed: int = 0
    chunks_created: int = 0
    files_deleted: int = 0
    chunks_embedded: int = 0


def reindex(spark: SparkSession, root: str, embedder: Embedder, own: Chunkers | None = None) -> Totals:
    """Index what was added, modified or deleted since the last commit. Files that chunkers of `own` cut count as code.

    Nothing shows before the one commit at the end, so a run that fails can simply be started again.
    """
    store = ChunkStore(spark, root)
    parent = store.snapshot()
    run = store.next_run(parent)
    files = scan_files(spark, root, P.load_config(root), own.extensions if own else ())

    # Later steps read this table back instead of listing and hashing the tree again.
    if parent is None:
        changes = files.withColumn("change", F.lit("added"))
    else:
        changes = detect_changes(with_hashes(files, root), store.meta(parent)).where("change <> 'unchanged'")
    changes = store.stage(changes, run)
    size = F.coalesce(F.sum(F.when(F.col("change") != "deleted", F.col("size"))), F.lit(0))
    counts = change_counts(changes, size.alias("read_bytes")).first()
    if counts["total"] == 0:
        store.discard(run)
        return Totals()

    processed = counts["added"] + counts["modified"]
    if processed:  # removing files needs no embedder
        embedder.ready()
        if parent and parent.dimensions not in (0, embedder.dimensions):
            raise ValueError(f"the index holds vectors of {parent.dimensions} numbers, not {embedder.dimensions}")
    tasks = read_tasks(spark, processed, counts["read_bytes"])
    texts = with_contents(changes.where("change in ('added', 'modified')"), root, tasks)
    chunks = embed_chunks(chunk_files(texts.withColumnRenamed("relative_path", "file_path"), own), embedder)
    written = store.commit(parent, run, changes, chunks, embedder.dimensions if processed else 0, counts["read_bytes"])
    store.remove_dead()
    return Totals(processed, written.made, counts["deleted"], written.kept)
