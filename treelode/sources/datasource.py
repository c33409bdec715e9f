"""A source tree as a data source: spark.read.format("treelode_tree").option("root", ...).load().

Planning lists directories breadth first only until there are about as many subtrees as `subtrees` says; each of these
is a partition that a task walks. Directories that no include pattern and no pushed filter on relative_path can reach are not
listed at all. With contents, a file is read only after pushed filters on its path and extension have let it through.

Filters are pushed with the option pushdown, which needs spark.sql.python.filterPushdown.enabled; otherwise Spark applies them. Use it
only where every query loads a frame of its own: Spark 4.1 keeps what was pushed into a loaded frame for its later queries.

Options: root; include, patterns parted by line ends (all files by default); contents, true to read texts and digests;
pushdown; subtrees, 256 by default. Letter case does not matter to include patterns, as in the scan.

Every read lists anew, which suits queries; an indexing run lists once and keeps what it found, see tree.py.
"""
from __future__ import annotations

import fnmatch
import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from treelode.functions import globs
from treelode.session import ship_package
from treelode.sources import project as P
from treelode.sources.tree import NEVER_ENTERED, READ_BYTES

NAME = "treelode_tree"
LISTED = "relative_path string, extension string, size bigint"
READ = LISTED + ", content string, hash string"
ROWS_AT_ONCE = 10_000


def parts_of(pattern: str) -> list[list[str]]:
    """The parts of each pattern that braces stand for, in lower case."""
    return [plain.lower().split("/") for plain in globs.expand_braces(globs.scan_pattern(pattern))]


def may_reach(folder: str, patterns: list[list[str]]) -> bool:
    """Whether a file below the folder could match one of the patterns."""
    names = folder.lower().split("/") if folder else []

    def reaches(pattern: list[str]) -> bool:
        for name, part in zip(names, pattern):
            if part == "**":
                return True
            if not fnmatch.fnmatchcase(name, part):
                return False
        return len(pattern) > len(names)

    return any(map(reaches, patterns))


class Subtree(InputPartition):
    """Folders that a task walks, and folders of which it only takes the files."""

    def __init__(self, walked: list[str], flat: list[str]):
        self.walked, self.flat = walked, flat


class Tests:
    """Filters that hold for every row: a prefix of the path, suffixes, extensions."""

    def __init__(self) -> None:
        self.prefixes: list[str] = []
        self.suffixes: list[str] = []
        self.paths: set[str] | None = None
        self.extensions: set[str] | None = None

    def take(self, given: Filter) -> bool:
        """Whether the filter is one that the reader can apply."""
        column = ".".join(given.attribute) if hasattr(given, "attribute") else ""
        values = {given.value} if isinstance(given, EqualTo) else set(given.value) if isinstance(given, In) else None
        if column == "relative_path" and isinstance(given, StringStartsWith):
            self.prefixes.append(given.value)
        elif column == "relative_path" and isinstance(given, StringEndsWith):
            self.suffixes.append(given.value)
        elif column == "relative_path" and values is not None:
            self.paths = values if self.paths is None else self.paths & values
        elif column == "extension" and values is not None:
            self.extensions = values if self.extensions is None else self.extensions & values
        else:
            return False
        return True

    def enters(self, folder: str) -> bool:
        """Whether a file below the folder could pass."""
        below = f"{folder}/" if folder else ""
        return all(below.startswith(prefix) or prefix.startswith(below) for prefix in self.prefixes) and (
            self.paths is None or any(path.startswith(below) for path in self.paths))

    def keeps(self, path: str, extension: str) -> bool:
        return (all(map(path.startswith, self.prefixes)) and all(map(path.endswith, self.suffixes))
                and (self.paths is None or path in self.paths) and (self.extensions is None or extension in self.extensions))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "root" not in options:
            raise ValueError("the option root must name a folder")
        self.root, self.subtrees = options["root"], int(options.get("subtrees", 256))
        self.contents = options.get("contents", "false").lower() == "true"
        include = [line for line in options.get("include", "").split("\n") if line]
        self.patterns = [parts for pattern in include for parts in parts_of(pattern)] or [["**"]]
        # The regex is Java's; Python writes the end of a text as \Z.
        self.included = re.sub(r"\\z\Z", r"\\Z", globs.glob_regex([globs.scan_pattern(p) for p in include], hidden=False)) if include else ""
        self.tests = Tests()

    def _below(self, filesystem: pafs.FileSystem, base: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders to enter and files of a folder."""
        folders, files = [], []
        for info in filesystem.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
            path = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type == pafs.FileType.File:
                files.append((path, info.size))
            elif info.type == pafs.FileType.Directory and info.base_name not in NEVER_ENTERED and self.enters(path):
                folders.append(path)
        return folders, files

    def enters(self, folder: str) -> bool:
        return may_reach(folder, self.patterns) and self.tests.enters(folder)

    def partitions(self) -> list[Subtree]:
        filesystem, base = P.open_root(self.root)
        waiting, flat = deque([""]), []
        while waiting and len(waiting) + len(flat) < self.subtrees:
            folder = waiting.popleft()
            folders, _ = self._below(filesystem, base, folder)
            flat.append(folder)
            waiting.extend(folders)
        walked = list(waiting)
        count = max(1, min(self.subtrees, len(walked) + len(flat)))
        dealt = [Subtree(walked[n::count], flat[n::count]) for n in range(count)]
        return [part for part in dealt if part.walked or part.flat]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        filesystem, base = P.open_root(self.root)
        rows: list[tuple] = []
        held = 0
        for path, size in self._files(filesystem, base, partition):
            extension = f".{path.rsplit('/', 1)[-1].rsplit('.', 1)[1]}" if "." in path.rsplit("/", 1)[-1] else ""
            if not self.tests.keeps(path, extension) or (self.included and not re.match(self.included, path)):
                continue
            row: tuple = (path, extension, size)
            if self.contents:
                try:
                    with filesystem.open_input_stream(f"{base}/{path}") as stream:
                        text = stream.read().decode("utf-8", "replace")
                except FileNotFoundError:  # gone since it was listed
                    continue
                row += (text, hashlib.sha256(text.encode()).hexdigest())
                held += len(text)
            rows.append(row)
            if len(rows) >= ROWS_AT_ONCE or held >= READ_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _files(self, filesystem: pafs.FileSystem, base: str, partition: Subtree) -> Iterator[tuple[str, int]]:
        for folder in partition.flat:
            yield from self._below(filesystem, base, folder)[1]
        stack = list(partition.walked)
        while stack:
            folders, files = self._below(filesystem, base, stack.pop())
            yield from files
            stack.extend(folders)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["relative_path", "extension", "size", "content", "hash"]
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names[:len(columns)])


class PushingReader(TreeReader):
    """Spark refuses a reader with this method where pushdown is not enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [given for given in filters if not self.tests.take(given)]


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ if self.options.get("contents", "false").lower() == "true" else LISTED

    def reader(self, schema) -> TreeReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else TreeReader
        return kind(dict(self.options))


def install(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship_package(spark)
    spark.dataSource.register(TreeSource)
