"""The six operations as functions that return DataFrames, and their JSON messages."""
from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelode.operators import search as S
from treelode.operators import tree as T
from treelode.operators.chunkers import Chunkers
from treelode.operators.embedding import Embedder, checked
from treelode.operators.outline import file_outline, symbol_source
from treelode.plans.reindex import Totals
from treelode.plans.reindex import reindex as run_reindex
from treelode.session import ship_package
from treelode.sources import project as P
from treelode.sources.store import ChunkStore, Snapshot
from treelode.sources.tree import one_file, scan_files

CODE_LIMIT, DOC_LIMIT = 10, 5
log = logging.getLogger(__name__)


class ToolError(Exception):
    """A request that cannot be answered; `payload` is what the caller is shown."""

    def __init__(self, payload: str | dict):
        super().__init__(payload if isinstance(payload, str) else payload["message"])
        self.payload = payload


class UnknownTool(Exception):
    """There is no operation of that name."""


def _required(value: Any, name: str, hint: str) -> None:
    if not isinstance(value, str) or not value:
        raise ToolError(f"Error: give a value for {name} ({hint})")


def _limit(value: Any, default: int) -> int:
    """A number of results: whole and not negative; JSON may say 5.0 for 5."""
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value // 1 or value < 0:
        raise ToolError(f"Error: limit must be a whole number from 0 on, not {value!r}")
    return int(value)


def _query_vector(embedder: Embedder, query: str) -> list[float]:
    embedder.ready()
    return checked(embedder, [query])[0]


def _store(spark: SparkSession, root: str) -> tuple[ChunkStore, Snapshot]:
    store = ChunkStore(spark, root)
    now = store.snapshot()
    if now is None:
        raise ToolError({
            "error": "NO_INDEX",
            "message": "This project has not been indexed yet; the reindex operation does that.",
            "project": root,
        })
    return store, now


def with_content(store: ChunkStore, winners: DataFrame) -> DataFrame:
    """Add stored columns to the winning rows, so the vector scan need not read every content.

    The winners, as many as the caller's limit, are taken to the driver with the files that hold them, and only those files
    are read.
    """
    found = winners.select("id", "_distance", "stored_in").collect()
    wanted = store.spark.createDataFrame([row[:2] for row in map(tuple, found)], "id string, _distance double")
    if not found:
        return winners.join(wanted, ["id", "_distance"]).withColumns({"content": F.lit(""), "name": F.lit(""), "chunk_type": F.lit(""), "line_end": F.lit(0)})
    rows = store.rows_in([row["stored_in"] for row in found]).drop("vector")
    return rows.join(F.broadcast(wanted), "id")


def has_index(spark: SparkSession, root: str) -> bool:
    """Whether anything was ever committed for the project."""
    return ChunkStore(spark, root).snapshot() is not None


def search_code(spark: SparkSession, root: str, query: str, embedder: Embedder, limit: int | None = None,
                extensions: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """Code chunks nearest to a query. An extension filter applies after a threefold over-fetch;
    `exact` applies it first, so that `limit` rows come back whenever that many match."""
    _required(query, "query", "string")
    limit = _limit(limit, CODE_LIMIT)
    ship_package(spark)
    store, now = _store(spark, root)
    chunks = store.chunks("code", now)
    vector = _query_vector(embedder, query)
    keys = chunks.where(S.is_code()).select(*S.TIE_BREAK, "stored_in", "vector")
    winners = S.nearest_with_extension(keys, vector, limit, extensions, exact)
    return S.code_results(with_content(store, winners)).orderBy("rank")


def search_docs(spark: SparkSession, root: str, query: str, embedder: Embedder, limit: int | None = None) -> DataFrame:
    """Documentation sections nearest to a query, with their full content."""
    _required(query, "query", "string")
    limit = _limit(limit, DOC_LIMIT)
    ship_package(spark)
    store, now = _store(spark, root)
    chunks = store.chunks("docs", now)
    vector = _query_vector(embedder, query)
    winners = S.nearest(chunks.where(S.is_doc()).select(*S.TIE_BREAK, "stored_in", "vector"), vector, limit)
    return S.doc_results(with_content(store, winners)).orderBy("rank")


@dataclass(frozen=True)
class ReindexResult:
    project: str
    totals: Totals
    auto_index: bool
    message: str


def reindex(spark: SparkSession, root: str, embedder: Embedder, enable_auto_index: bool | None = None, own: Chunkers | None = None) -> ReindexResult:
    """Index changed files, those of registered chunkers among them. An explicit flag is saved first; the first success without one turns it on."""
    ship_package(spark)
    if enable_auto_index is not None:
        P.save_rc(root, P.Rc(enable_auto_index))
    totals = run_reindex(spark, root, embedder, own)
    rc = P.load_rc(root)
    if totals.files_processed > 0 and enable_auto_index is None and not rc.auto_index:
        rc = P.Rc(True)
        P.save_rc(root, rc)
    if totals.files_processed == 0 and totals.files_deleted == 0:
        message = "Nothing has changed since the last run"
    else:
        message = (f"{totals.files_processed} files indexed in {totals.chunks_created} chunks, {totals.files_deleted} files gone; "
                   f"indexing at start is {'on' if rc.auto_index else 'off'}")
    return ReindexResult(root, totals, rc.auto_index, message)


def auto_index(spark: SparkSession, root: str, embedder: Embedder) -> ReindexResult | None:
    """What a scheduler calls: index if the embedder works and the project asks for it; a failure is logged, not raised."""
    try:
        embedder.ready()
        return reindex(spark, root, embedder) if P.load_rc(root).auto_index else None
    except Exception:
        log.exception("indexing %s at start failed", root)
        return None


def get_file_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Tree rows and the statistics row of the files a scan lists."""
    files = scan_files(spark, root)
    return T.file_tree(files), T.tree_stats(files)


def _file(spark: SparkSession, root: str, file: str) -> DataFrame:
    found = one_file(spark, root, file)
    if found is None:
        raise ToolError(f"Error: File not found: {file}")
    return found


def get_file_outline(spark: SparkSession, root: str, file: str) -> DataFrame:
    """One row: lines, imports, exports, symbols and warnings of a file."""
    _required(file, "file", "relative path from project root")
    return file_outline(_file(spark, root, file))


def get_symbol(spark: SparkSession, root: str, file: str, name: str, context: bool | None = None) -> DataFrame:
    """At most one row: source of a symbol and, unless `context` is false, what surrounds it."""
    _required(file, "file", "relative path from project root")
    _required(name, "name", "symbol name")
    return symbol_source(_file(spark, root, file), F.lit(name), True if context is None else context)


# -- messages -------------------------------------------------------------------------------------


def _rows(frame: DataFrame) -> list[dict]:
    return [row.asDict(recursive=True) for row in frame.collect()]


def _without_empty_warnings(row: dict) -> dict:
    return {k: v for k, v in row.items() if not (k == "warnings" and not v)}


def _say_search(results: DataFrame, query: str) -> dict:
    found = _rows(results)
    return {"query": query, "results_count": len(found), "results": found}


def _say_reindex(done: ReindexResult) -> dict:
    t = done.totals
    return {"success": True, "project": done.project, "files_processed": t.files_processed,
            "chunks_created": t.chunks_created, "files_deleted": t.files_deleted, "auto_index": done.auto_index,
            "message": done.message}


def _say_tree(tree: DataFrame, stats: DataFrame, root: str) -> Iterator[str]:
    """Parts of the JSON text, a file each: tasks write them, in order, and the driver holds one at a time."""
    yield json.dumps({"project": root, **_rows(stats)[0]}, ensure_ascii=False)[:-1] + ', "tree": {'
    inside = Window.partitionBy("dir").orderBy("file")
    quoted = lambda name: F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", 1)
    opens, closes = F.row_number().over(inside) == 1, F.lead("file").over(inside).isNull()
    part = F.concat(F.when(opens, F.concat(quoted("dir"), F.lit(": ["))).otherwise(""), quoted("file"), F.when(closes, "]").otherwise(", "))
    between = ""
    for row in tree.select("dir", "file", opens.alias("opens"), part.alias("part")).orderBy("dir", "file").toLocalIterator():
        yield (between if row.opens else "") + row.part
        between = ", "
    yield "}}"


def _say_outline(outline: DataFrame) -> dict:
    row = _rows(outline)[0]
    if row.pop("error"):
        raise ToolError(f"Error: {row['file']} could not be parsed")
    return _without_empty_warnings(row)


def _say_symbol(spark: SparkSession, root: str, found: DataFrame, file: str, name: str) -> dict:
    rows = _rows(found)
    if not rows:
        if file_outline(_file(spark, root, file)).where("error is not null").take(1):
            raise ToolError({"error": "PARSE_FAILED", "message": f"{file} could not be parsed", "file": file})
        raise ToolError(f'Error: Symbol "{name}" not found in {file}')
    said = {k: rows[0][k] for k in ("file", "symbol", "lines", "source")}
    around = {k: rows[0][k] for k in ("imports", "exports", "siblings", "warnings") if k in rows[0]}
    return {**said, "file_context": _without_empty_warnings(around)} if around else said


@dataclass(frozen=True)
class Operation:
    """Catalog entry: what it does, and parameters as name to (type, required)."""

    name: str
    about: str
    parameters: dict[str, tuple[str, bool]]
    run: Callable[..., dict | Iterator[str]]


OPERATIONS = {op.name: op for op in (
    Operation("search_code", "Code chunks whose meaning is nearest to a question, best first.", {"query": ("string", True), "limit": ("number", False), "extensions": ("array", False)},
              lambda s, r, e, a: _say_search(
                  search_code(s, r, a.get("query"), e, a.get("limit"), a.get("extensions")), a["query"])),
    Operation("search_docs", "Documentation sections nearest to a question, with their text.", {"query": ("string", True), "limit": ("number", False)},
              lambda s, r, e, a: _say_search(search_docs(s, r, a.get("query"), e, a.get("limit")), a["query"])),
    Operation("reindex", "Bring the index up to date: read, cut and embed the files that changed.", {"path": ("string", False), "enable_auto_index": ("boolean", False)},
              lambda s, r, e, a: _say_reindex(reindex(s, a.get("path") or r, e, a.get("enable_auto_index")))),
    Operation("get_file_tree", "Files by folder, with counts by kind and language.", {"path": ("string", False)},
              lambda s, r, e, a: _say_tree(*get_file_tree(s, a.get("path") or r), a.get("path") or r)),
    Operation("get_file_outline", "Imports, exports and symbols of one file, and its marked warnings.", {"file": ("string", True)},
              lambda s, r, e, a: _say_outline(get_file_outline(s, r, a.get("file")))),
    Operation("get_symbol", "Source of one symbol, with what stands around it unless told otherwise.", {"file": ("string", True), "name": ("string", True), "context": ("boolean", False)},
              lambda s, r, e, a: _say_symbol(
                  s, r, get_symbol(s, r, a.get("file"), a.get("name"), a.get("context")), a["file"], a["name"])),
)}


def answer(spark: SparkSession, root: str | None, embedder: Embedder, name: str, arguments: dict | None = None) -> dict:
    """Run an operation by name: {"text": JSON or message, "is_error": bool}.

    Without a root it is the project around the working directory.
    """
    if name not in OPERATIONS:
        raise UnknownTool(name)
    try:
        root = root or P.find_project_root(".")
        said = OPERATIONS[name].run(spark, root, embedder, arguments or {})
        text = json.dumps(said, indent=2, ensure_ascii=False) if isinstance(said, dict) else "".join(said)
        return {"text": text, "is_error": False}
    except ToolError as error:
        text = error.payload if isinstance(error.payload, str) else json.dumps(error.payload, indent=2)
        return {"text": text, "is_error": True}
    except Exception as error:
        log.exception("%s failed", name)
        return {"text": f"Error: {name} could not be completed: {error}", "is_error": True}
