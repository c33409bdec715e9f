"""Scan a source tree: list in parallel, filter with Columns, read contents in the tasks.

Spark's own file readers skip names that start with an underscore and drop empty files, both of which
belong to a project, so directories are listed by tasks instead. The driver never holds a listing.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.functions import globs
from treelode.functions import text as X
from treelode.session import settle, ship_package
from treelode.sources import project as P

READ_BYTES = 2 << 20
TASK_BYTES = 64 << 20
LIST_ROWS = 10_000
# Directories no scan can enter, because ignore rules that come last name them.
NEVER_ENTERED = {"node_modules", ".git", ".vectors", "dist"}


def _partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _seeds(filesystem: pafs.FileSystem, base: str, config: P.Config) -> list[str]:
    """Directories the include patterns start from; one inside another is left to the outer one."""
    starts = set()
    for pattern in (p for entry in config.include for p in globs.expand_braces(globs.scan_pattern(entry))):
        literal = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
        starts.add(literal.rpartition("/")[0].strip("/"))
    spelled = {found for start in starts for found in _spellings(filesystem, base, start)}
    return sorted(s for s in spelled if not any(o != s and (o == "" or s.startswith(o + "/")) for o in spelled))


def _spellings(filesystem: pafs.FileSystem, base: str, start: str) -> list[str]:
    """The directories that a path names when letter case does not matter, as in the include patterns."""
    found = [""]
    for part in start.split("/") if start else ():
        below = [info for folder in found for info in filesystem.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))]
        found = [info.path[len(base) + 1:] for info in below if info.type == pafs.FileType.Directory and info.base_name.lower() == part.lower()]
    return found


def _children(filesystem: pafs.FileSystem, base: str, folder: str, dots: bool) -> Iterator[tuple[str, int | None]]:
    """Paths below a directory, files with their size and directories with None."""
    selector = pafs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)
    for info in filesystem.get_file_info(selector):
        name = info.base_name
        path = f"{folder}/{name}" if folder else name
        if info.type == pafs.FileType.File:
            yield path, info.size
        elif info.type == pafs.FileType.Directory and name not in NEVER_ENTERED and (dots or not name.startswith(".")):
            yield path, None


def _lister(root: str, dots: bool):
    """Replace each directory row by its children. A row without a size is a directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = P.open_root(root)
        paths, sizes = [], []

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"relative_path": pa.array(paths, pa.string()), "size": pa.array(sizes, pa.int64())})
            paths.clear()
            sizes.clear()
            return out

        for batch in batches:
            for folder in batch.column("relative_path").to_pylist():
                for child, size in _children(filesystem, base, folder, dots):
                    paths.append(child)
                    sizes.append(size)
                    if len(paths) >= LIST_ROWS:
                        yield full()
        yield full()

    return run


def list_tree(spark: SparkSession, root: str, config: P.Config) -> DataFrame:
    """relative_path and size of every file below the include roots.

    One small job per level, each kept in the checkpoint folder: a level's directories are dealt to tasks by path, so that
    no task walks a subtree, and whatever reads the result later sees one and the same listing.
    """
    ship_package(spark)
    filesystem, base = P.open_root(root)
    dots = any(part.startswith(".") and part not in (".", "..") for entry in config.include for part in entry.split("/"))
    schema = "relative_path string, size bigint"
    seeds = _seeds(filesystem, base, config)
    folders, waiting, files = spark.createDataFrame([(seed, None) for seed in seeds], schema), len(seeds), None
    while True:
        folders = folders.repartition(max(1, min(waiting, _partitions(spark))), "relative_path")
        listed = settle(folders.mapInArrow(_lister(root, dots), schema))
        found = listed.where("size is not null")
        files = found if files is None else files.unionAll(found)
        folders = listed.where("size is null")
        waiting = folders.count()
        if not waiting:
            return files


def category_of(extension: Column, more_code: Sequence[str] = ()) -> Column:
    """code, docs, or null for an extension that is not supported. Case matters."""
    return F.when(extension.isin(*P.CODE_EXTENSIONS, *more_code), "code").when(extension.isin(*P.DOC_EXTENSIONS), "docs")


def select_files(paths: DataFrame, config: P.Config, rules: list[tuple[str, bool]], more_code: Sequence[str] = ()) -> DataFrame:
    """Include and exclude globs, ignore rules, extension and category over `relative_path`."""
    path = X.normal_path(F.col("relative_path"))
    return (
        paths.withColumn("relative_path", path)
        .withColumn("extension", X.extension_of(F.col("relative_path")))
        .withColumn("category", category_of(F.col("extension"), more_code))
        .where(F.col("category").isNotNull())
        .where(globs.included(F.col("relative_path"), config.include, config.exclude))
        .where(~globs.ignored(F.col("relative_path"), rules))
    )


def scan_files(spark: SparkSession, root: str, config: P.Config | None = None, more_code: Sequence[str] = ()) -> DataFrame:
    """absolute_path, relative_path, extension, category, size of the files of a project."""
    config = config or P.load_config(root)
    rules = globs.ignore_rules(P.ignore_lines(root))
    _, base = P.open_root(root)
    found = select_files(list_tree(spark, root, config), config, rules, more_code)
    return found.select(F.concat(F.lit(f"{base}/"), F.col("relative_path")).alias("absolute_path"),
                        "relative_path", "extension", "category", "size")


def _reader(root: str, hashes_only: bool):
    """Read files of a batch; a file that is gone by now is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = P.open_root(root)
        for batch in batches:
            rows, texts, digests, held = [], [], [], 0
            for at, path in enumerate(batch.column("absolute_path").to_pylist()):
                try:
                    with filesystem.open_input_stream(path) as stream:
                        text = stream.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue
                rows.append(at)
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                texts.append(None if hashes_only else text)
                held += 0 if hashes_only else len(text)
                if held >= READ_BYTES:
                    yield _joined(batch, rows, texts, digests)
                    rows, texts, digests, held = [], [], [], 0
            yield _joined(batch, rows, texts, digests)

    return run


def _joined(batch: pa.RecordBatch, rows: list[int], texts: list[str | None], digests: list[str]) -> pa.RecordBatch:
    kept = batch.take(pa.array(rows, pa.int32()))
    return (kept.append_column("content", pa.array(texts, pa.string()))
            .append_column("hash", pa.array(digests, pa.string())))


def _read(files: DataFrame, root: str, hashes_only: bool, tasks: int) -> DataFrame:
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields]
    spread = files.repartition(tasks, "relative_path")
    return spread.mapInArrow(_reader(root, hashes_only), ", ".join([*columns, "content string", "hash string"]))


def read_tasks(spark: SparkSession, files: int, size: int) -> int:
    """Tasks to read `files` files of `size` bytes: about 64 MB each, and no idle core if it can be helped."""
    return max(1, -(-size // TASK_BYTES), min(files, spark.sparkContext.defaultParallelism))


def with_contents(files: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Add the decoded text and its digest; one read per file."""
    return _read(files, root, False, tasks or _partitions(files.sparkSession))


def with_hashes(files: DataFrame, root: str) -> DataFrame:
    """Add the digest only: texts are read and hashed in the task and go no further."""
    return _read(files, root, True, _partitions(files.sparkSession)).drop("content")


def one_file(spark: SparkSession, root: str, file: str) -> DataFrame | None:
    """One file by its path below the root, whether or not a scan would list it; None if unreadable.

    A path that leads out of the root counts as unreadable.
    """
    ship_package(spark)
    path = file.replace("\\", "/")
    parts: list[str] = []
    for part in path.split("/"):
        if part == ".." and not parts:
            return None
        if part == "..":
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    text = P.read_text(root, "/".join(parts))
    if text is None:
        return None
    extension = "." + file.rsplit(".", 1)[-1]
    return spark.createDataFrame([(file, extension, text)], "file_path string, extension string, content string")
