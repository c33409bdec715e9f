"""Chunkers of one's own: a function for each extension, run as a table function that SQL calls with LATERAL.

    own = Chunkers()
    own.register(".sql", lambda path, text: [("function", "first", text, 1, 3)])
    own.install(spark)                      # SELECT f.file_path, c.* FROM files f, LATERAL own_chunks(f.file_path, f.content) c
    reindex(spark, root, embedder, own)     # or chunk_files(files, own)

A function gets the path and the text of a file and gives (chunk_type, name, body, line_start, line_end) for each chunk. It is
sent to the tasks, so it must pickle. Where it fails, the file is cut into line windows, as a text that built-in rules cannot cut.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.functions import text as X

Part = tuple[str, str, str, int, int]
Chunker = Callable[[str, str], Iterable[Part]]
PARTS = "ordinal int, chunk_type string, name string, body string, line_start int, line_end int"


def windows(path: str, text: str) -> Iterator[Part]:
    """Fixed windows, as for code without rules."""
    lines, base = text.split("\n"), path.rsplit("/", 1)[-1]
    if len(lines) <= X.SMALL_FILE_LINES:
        yield "module", base, text, 1, len(lines)
        return
    for first in range(0, len(lines), X.WINDOW_LINES):
        part = lines[first:first + X.WINDOW_LINES]
        yield "module", f"{base}:{first + 1}-{first + len(part)}", "\n".join(part), first + 1, first + len(part)


def checked(parts: Iterable[Part], lines: int) -> list[Part]:
    """All parts of a file, or an error where one is misshapen."""
    found = []
    for kind, name, body, first, last in parts:
        if not all(isinstance(x, str) for x in (kind, name, body)) or not 1 <= int(first) <= int(last) <= lines:
            raise ValueError(f"no chunk of a file of {lines} lines: {kind!r}, {name!r}, lines {first} to {last}")
        found.append((kind, name, body, int(first), int(last)))
    return found


class Chunkers:
    """Functions by extension; the longest extension that a path ends with decides."""

    def __init__(self) -> None:
        self.functions: dict[str, Chunker] = {}

    def register(self, extension: str, function: Chunker) -> None:
        """A later function for an extension replaces the earlier one; a missing leading dot is added."""
        self.functions[extension if extension.startswith(".") else f".{extension}"] = function

    @property
    def extensions(self) -> list[str]:
        return sorted(self.functions)

    def table_function(self):
        """(ordinal, chunk_type, name, body, line_start, line_end) of a path and its text; none without a function for it."""
        functions = sorted(self.functions.items(), key=lambda item: -len(item[0]))

        class OwnChunks:
            def eval(self, path: str, text: str):
                function = next((f for extension, f in functions if path is not None and path.endswith(extension)), None)
                if function is None or text is None:
                    return
                try:
                    found = checked(function(path, text), text.count("\n") + 1)
                except Exception:
                    found = list(windows(path, text))
                for ordinal, part in enumerate(found):
                    yield ordinal, *part

        return F.udtf(OwnChunks, returnType=PARTS)

    def install(self, spark: SparkSession, name: str = "own_chunks") -> None:
        """Make the functions registered so far callable from SQL."""
        spark.udtf.register(name, self.table_function())

    def cut(self, files: DataFrame) -> DataFrame:
        """file_path, hash and the parts of every file that has a function."""
        rows = files.select("file_path", "hash", "content").alias("f")
        parts = self.table_function()(F.col("f.file_path").outer(), F.col("f.content").outer())
        return rows.lateralJoin(parts.alias("p")).select("f.file_path", "f.hash", "p.*")
