"""Cut files into chunks: declarations, heading sections or fixed line windows.

All of it works on arrays inside one row, so a file never leaves its partition and nothing is
shuffled. An exploded row carries its own chunk text and never the whole file.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelode.functions import text as X
from treelode.functions.statements import LANGUAGE_OF
from treelode.operators.chunkers import Chunkers
from treelode.operators.outline import with_structure

def _part(kind, name: Column, body: Column, first: Column, last: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("chunk_type"), name.alias("name"), body.alias("body"),
                    first.cast("int").alias("line_start"), last.cast("int").alias("line_end"))


def _whole() -> Column:
    """The file as a single module chunk."""
    return F.array(_part("module", X.base_name(F.col("file_path")), F.col("content"), F.lit(1), F.size("lines")))


def _file_header() -> Column:
    return F.concat(F.lit("// File: "), F.col("file_path"))


def window_parts() -> Column:
    """Fixed windows of 200 lines; a file of up to 50 lines stays whole. Needs `lines`."""
    total, lines = F.size("lines"), F.col("lines")

    def window(first: Column) -> Column:
        last = F.least(first + X.WINDOW_LINES - 1, total)
        name = F.concat(X.base_name(F.col("file_path")), F.lit(":"), X.line_label(first, last))
        return _part("module", name, X.line_slice(lines, first, last), first, last)

    windows = F.transform(F.sequence(F.lit(1), total, F.lit(X.WINDOW_LINES)), window)
    return F.when(total <= X.SMALL_FILE_LINES, _whole()).otherwise(windows)


def heading_parts() -> Column:
    """Sections that start at a level 1 to 3 heading. Needs `lines` and `starts`.

    The first section takes the file name even when line 1 is a heading; empty sections are dropped.
    """
    lines, starts = F.col("lines"), F.col("starts")

    def section(first: Column, at: Column) -> Column:
        last = F.coalesce(F.get(starts, at + 1) - 1, F.size(lines))
        title = X.heading_title(F.element_at(lines, first))
        name = F.when(at == 0, X.base_name(F.col("file_path"))).otherwise(title)
        return _part("doc_section", name, X.js_trim(X.line_slice(lines, first, last)), first, last)

    return F.filter(F.transform(starts, section), lambda s: s["body"] != "")


def heading_starts(lines: Column) -> Column:
    """Line numbers at which a section begins: 1, and every later heading line."""
    marked = F.transform(lines, lambda line, i: F.when((i == 0) | X.is_heading(line), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def symbol_parts() -> Column:
    """One chunk per named declaration. Needs `lines` and `symbols`."""
    lines = F.col("lines")
    each = F.transform(F.col("symbols"), lambda s: _part(
        s["kind"], s["name"], X.line_slice(lines, s["line_start"], s["line_end"]), s["line_start"], s["line_end"]))
    whole = (F.size("lines") <= X.SMALL_FILE_LINES) | (F.size("symbols") == 0)
    return F.when(whole, _whole()).otherwise(each)


def _explode(files: DataFrame, parts: Column, header: Column) -> DataFrame:
    """Rows of chunks with an id that depends only on the file, its text and the position.

    The header joins its chunks after the explode: a file with many names has a long one, and the row
    of the file should not hold it once per chunk.
    """
    return _identified(files.select("file_path", "hash", header.alias("header"), F.posexplode(parts).alias("ordinal", "part")))


def _identified(spread: DataFrame) -> DataFrame:
    """Chunk rows of (file_path, hash, header, ordinal, part)."""
    identity = F.concat_ws("\x00", "file_path", "hash", F.col("ordinal").cast("string"),
                           X.line_label(F.col("part.line_start"), F.col("part.line_end")))
    section = F.when(F.col("part.chunk_type") == "doc_section", F.concat(F.lit("\n// Section: "), F.col("part.name")))
    content = F.concat(F.col("header"), F.coalesce(section, F.lit("")), F.lit("\n\n"), F.col("part.body"))
    return spread.select(F.sha2(identity, 256).alias("id"), "file_path", "part.chunk_type", "part.name",
                         content.alias("content"), "part.line_start", "part.line_end", "hash")


def _prepared(files: DataFrame) -> DataFrame:
    if "hash" not in files.columns:
        files = files.withColumn("hash", X.content_hash(F.col("content")))
    return files.withColumn("lines", X.lines_of(F.col("content")))


def _code_header() -> Column:
    """File line, names and imports; the file line alone for a text that could not be cut."""
    full = X.chunk_header(F.col("file_path"), F.col("exports"), F.col("imports"))
    return F.when(F.col("symbols").isNull(), _file_header()).otherwise(full)


def chunk_windows(files: DataFrame) -> DataFrame:
    """Code without declaration rules."""
    return _explode(_prepared(files), window_parts(), _file_header())


def chunk_headings(files: DataFrame) -> DataFrame:
    """Documentation."""
    found = _prepared(files).withColumn("starts", heading_starts(F.col("lines")))
    return _explode(found, heading_parts(), _file_header())


def chunk_symbols(files: DataFrame) -> DataFrame:
    """Code with declaration rules; a text that cannot be cut falls back to line windows."""
    found = with_structure(_prepared(files))
    parts = F.when(F.col("symbols").isNull(), window_parts()).otherwise(symbol_parts())
    return _explode(found, parts, _code_header())


def chunk_own(files: DataFrame, own: Chunkers) -> DataFrame:
    """Files that a registered chunker cuts."""
    part = F.struct("chunk_type", "name", "body", "line_start", "line_end")
    return _identified(own.cut(_prepared(files)).select("file_path", "hash", _file_header().alias("header"), "ordinal", part.alias("part")))


def chunk_files(files: DataFrame, own: Chunkers | None = None) -> DataFrame:
    """Dispatch on category and extension in a single pass over `files`; registered chunkers come before the built-in rules.

    Input columns: file_path, extension, category, content and optionally hash.
    """
    if own and own.extensions:
        mine = F.col("extension").isin(own.extensions)
        return chunk_own(files.where(mine), own).unionByName(chunk_files(files.where(~mine)))
    docs = F.col("category") == "docs"
    code = F.col("extension").isin(*LANGUAGE_OF) & F.col("symbols").isNotNull()
    found = with_structure(_prepared(files)).withColumn("starts", F.when(docs, heading_starts(F.col("lines"))))
    parts = F.when(docs, heading_parts()).when(code, symbol_parts()).otherwise(window_parts())
    return _explode(found, parts, F.when(~docs & code, _code_header()).otherwise(_file_header()))
