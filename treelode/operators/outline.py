"""Structure of files: outline, symbol source and surrounding context, for one file or all of them.

Every operator maps a file row to result rows without a shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelode.functions import languages as L
from treelode.functions import text as X
from treelode.functions.statements import LANGUAGE_OF, statements_of

NO_NAMES = "array<string>"
NO_SYMBOLS = "array<struct<name:string,kind:string,line_start:int,line_end:int>>"


def with_statements(files: DataFrame) -> DataFrame:
    return files.withColumn("statements", statements_of(F.col("content"), F.col("extension")))


def with_structure(files: DataFrame) -> DataFrame:
    """Add symbols, imports and exports; all three are null where the text could not be cut.

    Files of other extensions get empty arrays.
    """
    parsed = F.col("extension").isin(*LANGUAGE_OF)
    ext, cut = F.col("extension"), F.col("statements")
    symbols = F.when(parsed, L.symbols_of(cut, ext)).otherwise(F.array().cast(NO_SYMBOLS))
    imports = F.when(parsed & cut.isNotNull(), L.imports_of(cut, ext))
    imports = imports.when(~parsed, F.array().cast(NO_NAMES))
    return (
        with_statements(files)
        .withColumns({"symbols": symbols, "imports": imports})
        .withColumn("exports", L.exports_of(F.col("symbols")))
        .drop("statements")
    )


def symbol_labels(symbols: Column) -> Column:
    """Symbols as name, kind and `start-end`."""
    return F.transform(symbols, lambda s: F.struct(
        s["name"].alias("name"), s["kind"].alias("kind"), X.line_label(s["line_start"], s["line_end"]).alias("lines")))


def warnings_of(content: Column, extension: Column) -> Column:
    """Warning lines; only the parsed extensions have any."""
    return F.when(extension.isin(*LANGUAGE_OF), X.warning_lines(content)).otherwise(F.array().cast(NO_NAMES))


def symbol_rows(files: DataFrame) -> DataFrame:
    """One row per symbol: file_path, position, name, kind, line_start, line_end."""
    # An expression instead of the bare column: the optimizer would add a size filter for a column,
    # and evaluate the statement function for it a second time.
    symbols = F.coalesce(F.col("symbols"), F.array().cast(NO_SYMBOLS))
    spread = with_structure(files).select("file_path", F.posexplode(symbols).alias("position", "symbol"))
    return spread.select("file_path", "position", "symbol.*")


def file_outline(files: DataFrame) -> DataFrame:
    """One row per file: lines, imports, exports, symbols_count, symbols, warnings, error."""
    content, ext = F.col("content"), F.col("extension")
    found = with_structure(files)
    return found.select(
        F.col("file_path").alias("file"),
        X.line_count(content).alias("lines"),
        "imports",
        "exports",
        F.size("symbols").alias("symbols_count"),
        symbol_labels(F.col("symbols")).alias("symbols"),
        warnings_of(content, ext).alias("warnings"),
        F.when(F.col("symbols").isNull(), F.lit("PARSE_FAILED")).alias("error"),
    )


def sibling_labels(symbols: Column, name: Column) -> Column:
    """`kind name (start-end)` of every symbol with another name."""
    others = F.filter(symbols, lambda s: s["name"] != name)
    return F.transform(others, lambda s: F.concat(
        s["kind"], F.lit(" "), s["name"], F.lit(" ("), X.line_label(s["line_start"], s["line_end"]), F.lit(")")))


def symbol_source(files: DataFrame, name: Column, context: bool = True) -> DataFrame:
    """First symbol called `name` in each file that has one: lines, source and, if asked, context.

    `name` may be a literal or a column of `files`.
    """
    content = F.col("content")
    # Exploding the first match, rather than filtering on it, keeps the optimizer from copying the
    # statement function below the filter and running it twice.
    match = F.slice(F.filter(F.col("symbols"), lambda s: s["name"] == F.col("wanted")), 1, 1)
    structure = with_structure(files.withColumn("wanted", name))
    found = structure.select(*structure.columns, F.explode(match).alias("found"))
    columns = [
        F.col("file_path").alias("file"),
        F.col("wanted").alias("symbol"),
        X.line_label(F.col("found.line_start"), F.col("found.line_end")).alias("lines"),
        X.line_slice(X.lines_of(content), F.col("found.line_start"), F.col("found.line_end")).alias("source"),
    ]
    if context:
        columns += [
            "imports",
            "exports",
            sibling_labels(F.col("symbols"), F.col("wanted")).alias("siblings"),
            warnings_of(content, F.col("extension")).alias("warnings"),
        ]
    return found.select(*columns)
