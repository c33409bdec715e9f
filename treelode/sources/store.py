"""Stored chunks and state as Parquet, copied on write by hash bucket of the path.

    chunks/run=R/bucket=B/kind=K    rows of a bucket as run R left them
    meta/run=R/bucket=B             state rows of the same files
    snapshot/n=N                    which run each bucket is read from; written last, so it is the commit

A run reads only the buckets that hold a changed path, drops the changed files from them with an anti join, adds what is new and
writes those buckets anew. Readers open the folders that the newest finished snapshot names: rows need no
version, readers no join, and nothing has to be compacted. A run that dies leaves no snapshot and so nothing visible. One run may
write at a time; a second one that finds its snapshot number taken fails.
"""
from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelode import schema
from treelode.operators.changes import meta_rows
from treelode.sources.project import root_uri

# A bucket is what one changed file costs to write again, and a task or a few write it.
BUCKET_BYTES = 256 << 20
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
DEAD_AFTER_S = 24 * 3600

CHANGES = T.StructType([
    T.StructField("relative_path", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("absolute_path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("change", T.StringType()),
])
_PLACE = [T.StructField("run", T.LongType()), T.StructField("bucket", T.IntegerType())]
_TABLES = {
    "chunks": T.StructType([*schema.STORED_CHUNKS.fields, *_PLACE, T.StructField("kind", T.StringType())]),
    "meta": T.StructType([*schema.META.fields, *_PLACE]),
}
_SNAPSHOT = "bucket int, chunks_run long, meta_run long, buckets int, dimensions int"


class NoIndex(Exception):
    """The project has no committed index."""


class ConcurrentCommit(Exception):
    """Another run committed first."""


@dataclass(frozen=True)
class Snapshot:
    """Where each bucket is read from; a bucket without rows is not there."""

    number: int = 0
    buckets: int = LEAST_BUCKETS
    dimensions: int = 0
    chunks: dict[int, int] = field(default_factory=dict)
    meta: dict[int, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Written:
    """`made` chunks came in, `kept` of them with a vector; `carried` are older rows that were written again."""

    made: int = 0
    kept: int = 0
    carried: int = 0


def buckets_for(size: int) -> int:
    """How many buckets a new index of `size` bytes gets; they stay as many."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.base = f"{root_uri(root)}/.vectors/store"

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, name: str) -> list[int]:
        """Numbers n of the folders `name`=n directly below."""
        target, files = self._hadoop(folder)
        if not files.exists(target):
            return []
        names = [status.getPath().getName() for status in files.listStatus(target)]
        return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))

    # -- snapshots --------------------------------------------------------------------------------

    def snapshot(self) -> Snapshot | None:
        """The newest finished snapshot, at most MOST_BUCKETS rows, or None before the first commit."""
        for number in reversed(self._numbers(f"{self.base}/snapshot", "n")):
            done, files = self._hadoop(f"{self.base}/snapshot/n={number}/_SUCCESS")
            if files.exists(done):
                rows = self.spark.read.schema(_SNAPSHOT).parquet(f"{self.base}/snapshot/n={number}").collect()
                return Snapshot(number, rows[0].buckets, rows[0].dimensions, {r.bucket: r.chunks_run for r in rows if r.chunks_run},
                                {r.bucket: r.meta_run for r in rows if r.meta_run})
        return None

    def _publish(self, now: Snapshot) -> None:
        places = sorted({-1, *now.chunks, *now.meta})  # -1 keeps the numbers of an index without rows
        rows = [(b, now.chunks.get(b), now.meta.get(b), now.buckets, now.dimensions) for b in places]
        if now.number in self._numbers(f"{self.base}/snapshot", "n"):
            raise ConcurrentCommit(f"snapshot {now.number} is taken")
        self.spark.createDataFrame(rows, _SNAPSHOT).coalesce(1).write.mode("errorifexists").parquet(f"{self.base}/snapshot/n={now.number}")

    def next_run(self, parent: Snapshot | None) -> int:
        """Later than every run of the snapshot even if clocks differ."""
        return max([time.time_ns() // 1000, *(run + 1 for run in (*parent.chunks.values(), *parent.meta.values()))] if parent else [time.time_ns() // 1000])

    # -- reading ----------------------------------------------------------------------------------

    def _read(self, table: str, places: dict[int, int]) -> DataFrame:
        """Rows of some buckets, each as one run left it. Only their folders are listed."""
        if not places:
            return self.spark.createDataFrame([], _TABLES[table])
        reader = self.spark.read.schema(_TABLES[table]).option("basePath", f"{self.base}/{table}")
        return reader.parquet(*[f"{self.base}/{table}/run={run}/bucket={bucket}" for bucket, run in sorted(places.items())])

    def _now(self, snapshot: Snapshot | None) -> Snapshot:
        found = snapshot or self.snapshot()
        if found is None:
            raise NoIndex(self.base)
        return found

    def chunks(self, kind: str | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Chunks with a vector; `kind` is code or docs and prunes partitions.

        `stored_in` names the Parquet file of a row, so that `rows_in` can go back to a few of them.
        """
        places = self._now(snapshot).chunks
        rows = self._read("chunks", places)
        rows = rows.withColumn("stored_in", F.col("_metadata.file_path") if places else F.lit(None).cast("string"))
        return rows.where(F.col("kind") == kind) if kind else rows.where(F.col("kind") != "failed")

    def rejected(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Chunks that the embedder refused, with the reason."""
        return self._read("chunks", self._now(snapshot).chunks).where("kind = 'failed'").select("file_path", "id", "name", "line_start", "line_end", "reason")

    def meta(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self._read("meta", self._now(snapshot).meta).drop("run", "bucket")

    def rows_in(self, files: Sequence[str]) -> DataFrame:
        """All chunk rows of some Parquet files, as `stored_in` names them."""
        reader = self.spark.read.schema(_TABLES["chunks"]).option("basePath", f"{self.base}/chunks")
        return reader.parquet(*sorted({unquote(file) for file in files}))

    # -- writing ----------------------------------------------------------------------------------

    def stage(self, changes: DataFrame, run: int) -> DataFrame:
        """Keep what a run found, so that its later steps all see one listing; read back."""
        changes.select(*CHANGES.names).write.mode("errorifexists").parquet(f"{self.base}/changes/run={run}")
        return self.spark.read.schema(CHANGES).parquet(f"{self.base}/changes/run={run}")

    def discard(self, run: int) -> None:
        """Remove what a run wrote that will not be committed."""
        for table in ("changes", *_TABLES):
            folder, files = self._hadoop(f"{self.base}/{table}/run={run}")
            files.delete(folder, True)

    def commit(self, parent: Snapshot | None, run: int, changed: DataFrame, fresh: DataFrame, dimensions: int, size: int = 0) -> Written:
        """Replace the files of `changed` (relative_path) by the chunks of `fresh`, and publish.

        A deleted file has no fresh chunks. Rows are counted while they are written.
        """
        old = parent or Snapshot(buckets=buckets_for(size))

        def bucket(path: str) -> Column:
            return F.pmod(F.xxhash64(path), F.lit(old.buckets)).cast("int").alias("bucket")

        paths = changed.select("relative_path").distinct()
        touched = {row.bucket for row in paths.select(bucket("relative_path")).distinct().collect()}
        counted = Observation()
        marked = stored_form(fresh).select(*schema.STORED_CHUNKS.names, "kind", F.lit(True).alias("new"))
        carried = self._read("chunks", {b: r for b, r in old.chunks.items() if b in touched})
        carried = carried.join(paths, F.col("file_path") == F.col("relative_path"), "left_anti")
        rows = carried.select(*schema.STORED_CHUNKS.names, "kind", F.lit(False).alias("new")).unionByName(marked)
        # Counted behind the exchange, where a task that runs again is not counted again.
        rows = rows.withColumn("bucket", bucket("file_path")).hint("rebalance", "bucket").observe(
            counted, F.count_if("new").alias("made"), F.count_if(F.col("new") & (F.col("kind") != "failed")).alias("kept"), F.count_if(~F.col("new")).alias("carried"))
        writer = rows.drop("new").write.mode("errorifexists").partitionBy("bucket", "kind")
        # Lets a lookup of a few ids skip nearly every row group.
        writer.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{self.base}/chunks/run={run}")
        chunks = dict.fromkeys(self._numbers(f"{self.base}/chunks/run={run}", "bucket"), run)

        state = self._read("meta", {b: r for b, r in old.meta.items() if b in touched}).join(paths, "relative_path", "left_anti").drop("run", "bucket")
        written = self._read("chunks", chunks).where("kind <> 'failed'").join(paths, F.col("file_path") == F.col("relative_path"), "left_semi")
        state = state.unionByName(meta_rows(written)).withColumn("bucket", bucket("relative_path"))
        state.hint("rebalance", "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.base}/meta/run={run}")
        meta = dict.fromkeys(self._numbers(f"{self.base}/meta/run={run}", "bucket"), run)

        left = lambda places: {b: r for b, r in places.items() if b not in touched}
        self._publish(Snapshot(old.number + 1, old.buckets, dimensions or old.dimensions, left(old.chunks) | chunks, left(old.meta) | meta))
        return Written(**counted.get)

    def remove_dead(self, older_than_s: float = DEAD_AFTER_S) -> int:
        """Remove buckets that the newest snapshot does not read, once they are older than any reader or run may be.

        Deleted and replaced texts leave the disk this way. Returns how many folders went.
        """
        now, removed = self._now(None), 0
        limit = time.time_ns() // 1000 - int(older_than_s * 1e6)
        for table, places in (("chunks", now.chunks), ("meta", now.meta), ("changes", {})):
            for run in self._numbers(f"{self.base}/{table}", "run"):
                buckets = [f"/bucket={b}" for b in self._numbers(f"{self.base}/{table}/run={run}", "bucket") if places.get(b) != run] or ([""] if not places else [])
                for dead in buckets if run < limit else ():
                    folder, files = self._hadoop(f"{self.base}/{table}/run={run}{dead}")
                    removed += bool(files.delete(folder, True))
        return removed


def stored_form(embedded: DataFrame) -> DataFrame:
    """Add the storage partition: code, docs, or failed for a chunk without a vector."""
    kind = (
        F.when(F.col("vector").isNull(), "failed")
        .when(F.col("chunk_type") == "doc_section", "docs")
        .otherwise("code")
    )
    return embedded.withColumn("kind", kind)
