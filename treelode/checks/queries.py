"""Registered queries: each operator over whole tables. Lists are joined to text for comparison."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.checks import views as V
from treelode.functions import globs
from treelode.functions import text as X
from treelode.operators import changes as C
from treelode.operators import chunking as K
from treelode.operators import outline as O
from treelode.operators import search as S
from treelode.operators import tree as T
from treelode.functions.vectors import squared_l2
from treelode.operators.chunkers import Chunkers
from treelode.operators.embedding import HashingEmbedder, embed_chunks
from treelode.operators.knn_join import COSINE, nearest_join
from treelode.plans.reindex import Totals
from treelode.plans.tools import reindex, with_content
from treelode.session import settle, shared_folder, ship_package, spread
from treelode.sources import datasource
from treelode.sources import project as P
from treelode.sources.store import CHANGES, ChunkStore, Written
from treelode.sources.tree import category_of, select_files

Query = Callable[[SparkSession, str], DataFrame]
QUERY_ID, QUERY_STEP = 3, 20
STORE_LIMIT = 2000
EMBED_DIMENSIONS = 64
SEARCH_TEXT = "the of and la de und"


def six(value: Column) -> Column:
    """Six decimals, half up, the same way in both engines."""
    return F.floor(value * 1e6 + 0.5) / F.lit(1e6)


def joined(names: Column) -> Column:
    return F.array_join(names, "|")


# -- search ---------------------------------------------------------------------------------------


def _vector(spark: SparkSession, folder: str) -> list[float]:
    return V.query_vectors(spark, folder, QUERY_ID)[0][1]


def knn_search_code(spark: SparkSession, folder: str) -> DataFrame:
    chunks = V.chunk_vectors(spark, folder).where(S.is_code())
    return S.code_results(V.with_text(S.nearest(chunks, _vector(spark, folder), 10)))


def knn_search_docs(spark: SparkSession, folder: str) -> DataFrame:
    chunks = V.chunk_vectors(spark, folder).where(S.is_doc())
    return S.doc_results(V.with_text(S.nearest(chunks, _vector(spark, folder), 5)))


def knn_ext_postfilter(spark: SparkSession, folder: str, exact: bool = False) -> DataFrame:
    chunks = V.chunk_vectors(spark, folder).where(S.is_code())
    found = S.nearest_with_extension(chunks, _vector(spark, folder), 10, [".py", "go"], exact)
    return S.ranked(found).select("rank", F.col("file_path").alias("file"), six(F.col("_distance")).alias("distance"))


def knn_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth row as a query, against all rows."""
    chunks = V.chunk_vectors(spark, folder)
    queries = chunks.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "vector")
    found = nearest_join(chunks.drop("vec_id"), queries, 10)
    return found.select("query_id", "rank", F.col("id").alias("chunk_id"), six(F.col("_distance")).alias("distance"))


def _store(spark: SparkSession, name: str) -> ChunkStore:
    return ChunkStore(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def _put(store: ChunkStore, rows: DataFrame, changed: DataFrame) -> Written:
    """Commit chunk rows (STORED_CHUNKS without reason) in place of the files of `changed` (relative_path, change)."""
    parent = store.snapshot()
    run = store.next_run(parent)
    changes = changed.select("relative_path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in CHANGES.fields[1:-1]], "change")
    return store.commit(parent, run, store.stage(changes, run), rows.withColumn("reason", F.lit(None).cast("string")), EMBED_DIMENSIONS)


def _filled_store(spark: SparkSession, folder: str) -> ChunkStore:
    """A store with four commits: every chunk; a third of the files changed; those changed back; every tenth file deleted."""
    store = _store(spark, "store")
    every = V.with_text(V.chunk_vectors(spark, folder)).withColumn("hash", F.md5("content"))
    third, gone = every.where("vec_id % 3 = 0"), every.where("vec_id % 10 = 7")
    other = third.withColumns({"content": F.concat(F.lit("other "), "content"), "vector": F.transform("vector", lambda x: -x)})
    for rows, change in ((every, "added"), (other, "modified"), (third, "modified"), (gone, "deleted")):
        _put(store, rows.where(F.lit(change != "deleted")), rows.select(F.col("file_path").alias("relative_path"), F.lit(change).alias("change")))
    return store


def search_store(spark: SparkSession, folder: str) -> DataFrame:
    store = _filled_store(spark, folder)
    keys = store.chunks("code").where(S.is_code()).select(*S.TIE_BREAK, "stored_in", "vector")
    found = with_content(store, S.nearest(keys, _vector(spark, folder), STORE_LIMIT))
    return S.ranked(found).select("rank", F.col("file_path").alias("file"), six(F.col("_distance")).alias("distance"), F.md5("content").alias("content_md5"))


def store_state(spark: SparkSession, folder: str) -> DataFrame:
    """What the store says about every live file after those commits: its state row and its text."""
    store = _filled_store(spark, folder)
    before = store.meta().select("relative_path", "hash", joined(F.col("chunk_ids")).alias("ids"))
    after = store.chunks().select(F.col("file_path").alias("relative_path"), F.md5("content").alias("content_md5"))
    return before.join(after, "relative_path", "full_outer")


def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """As knn_batch, over documentation, by the angle between vectors."""
    chunks = V.chunk_vectors(spark, folder)
    queries = chunks.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "vector")
    found = nearest_join(chunks.where(S.is_doc()).drop("vec_id"), queries, 5, metric=COSINE)
    return found.select("query_id", "rank", F.col("id").alias("chunk_id"), six(F.col("_distance")).alias("distance"))


def preview(spark: SparkSession, folder: str) -> DataFrame:
    distance = squared_l2(F.col("vector"), _vector(spark, folder))
    return V.with_text(V.chunk_vectors(spark, folder)).select(
        F.col("id").alias("chunk_id"), X.score_of(distance).alias("score"), X.preview_of(F.col("content")).alias("preview"))


def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    files = V.doc_files(spark, folder, spread).select(F.col("relative_path").alias("file"), "content")
    found = embed_chunks(files, HashingEmbedder(EMBED_DIMENSIONS))
    vector = F.col("vector")
    return found.select(
        "file", F.size(F.filter(vector, lambda x: x > 0)).alias("filled"),
        F.round(F.array_max(vector).cast("double"), 4).alias("largest"),
        F.array_position(vector, F.array_max(vector)).cast("int").alias("largest_at"))


def search_text(spark: SparkSession, folder: str) -> DataFrame:
    """A text query against embedded documents."""
    embedder = HashingEmbedder(EMBED_DIMENSIONS)
    files = V.doc_files(spark, folder, spread).select(
        F.col("relative_path").alias("file_path"), F.lit(1).alias("line_start"), F.col("relative_path").alias("id"), "content")
    found = S.nearest(embed_chunks(files, embedder), embedder.embed([SEARCH_TEXT])[0], 10)
    return S.ranked(found).select("rank", F.col("file_path").alias("file"), F.round("_distance", 4).alias("distance"))


# -- scan and tree ----------------------------------------------------------------------------------


def scan_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = globs.ignore_rules([*V.IGNORE_LINES, *P.ALWAYS_IGNORED])
    return select_files(V.shaped_paths(spark, folder), P.Config(), rules).select("relative_path", "extension", "category")


def tree_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as files, read back through the data source."""
    root = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    V.write_tree(V.doc_files(spark, folder), root)
    datasource.install(spark)
    files = spark.read.format(datasource.NAME).option("root", root).option("include", "docs/*/de/*.md\ndocs/*/en/**").option("contents", "true").load()
    return files.select("relative_path", "extension", "size", "hash", F.md5("content").alias("content_md5"))


def categorise(spark: SparkSession, folder: str) -> DataFrame:
    extension = X.extension_of(F.col("relative_path"))
    typed = V.shaped_paths(spark, folder).select(extension.alias("extension"), category_of(extension).alias("category"))
    return typed.groupBy("extension", "category").agg(F.count("*").alias("files"))


def file_tree(spark: SparkSession, folder: str) -> DataFrame:
    return T.file_tree(V.project_files(spark, folder))


def tree_stats(spark: SparkSession, folder: str) -> DataFrame:
    return T.tree_stats(V.project_files(spark, folder)).withColumn("languages", joined(F.col("languages")))


def directory_counts(spark: SparkSession, folder: str) -> DataFrame:
    return T.directory_counts(V.project_files(spark, folder))


def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return T.category_counts(V.project_files(spark, folder))


# -- change detection -------------------------------------------------------------------------------


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return V.hashed(V.doc_files(spark, folder))


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    return V.doc_files(spark, folder).select("relative_path", X.line_count(F.col("content")).alias("lines"))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return C.detect_changes(V.hashed(V.new_state(spark, folder)), V.hashed(V.old_state(spark, folder)))


def change_detect(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).select("relative_path", "change")


def change_summary(spark: SparkSession, folder: str) -> DataFrame:
    return C.change_counts(_changes(spark, folder))


def deleted_paths(spark: SparkSession, folder: str) -> DataFrame:
    return C.deleted_paths(V.hashed(V.new_state(spark, folder)), V.hashed(V.old_state(spark, folder)))


# -- chunking ---------------------------------------------------------------------------------------


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "file_path", "chunk_type", "name", F.md5("content").alias("content_md5"), "line_start", "line_end")


def chunk_small(spark: SparkSession, folder: str) -> DataFrame:
    files = V.long_files(spark, folder).where(X.line_count(F.col("content")) <= X.SMALL_FILE_LINES)
    return _chunk_rows(K.chunk_windows(files))


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_rows(K.chunk_windows(V.long_files(spark, folder)))


def chunk_headings(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_rows(K.chunk_headings(V.heading_files(spark, folder)))


def chunk_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_rows(K.chunk_symbols(V.source_files(spark, folder, "python"))).drop("id")


def chunk_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Documentation, parsed code and other code in one frame."""
    columns = ["file_path", "extension", "category", "content"]
    files = (V.long_files(spark, folder).select(columns)
             .unionAll(V.heading_files(spark, folder).select(columns))
             .unionAll(V.source_files(spark, folder, "go").select(columns)))
    chunks = K.chunk_files(files)
    return chunks.groupBy("chunk_type", "line_start", "line_end").agg(F.count("*").alias("chunks"))


def _line_chunks(path: str, text: str) -> Iterator[tuple]:
    """Every line that is not blank."""
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip(" "):
            yield "function", f"L{n}", line, n, n


def chunk_registered(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut by a registered function, called from SQL."""
    own = Chunkers()
    own.register(".sql", _line_chunks)
    own.install(spark)
    found = spark.sql("SELECT f.file_path, c.* FROM {files} f, LATERAL own_chunks(f.file_path, f.content) c", files=V.long_files(spark, folder))
    return found.select("file_path", "ordinal", "name", "line_start", "line_end", F.md5("body").alias("body_md5"))


def warning_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = O.warnings_of(F.col("content"), F.col("extension"))
    return V.marked_files(spark, folder).select("file_path", F.explode(found).alias("warning"))


# -- structure --------------------------------------------------------------------------------------


def symbols(language: str, spark: SparkSession, folder: str) -> DataFrame:
    return O.symbol_rows(V.source_files(spark, folder, language))


def html_outline(spark: SparkSession, folder: str) -> DataFrame:
    pages = V.page_files(spark, folder).select(F.col("relative_path").alias("file_path"), F.lit(".html").alias("extension"), "content")
    return O.symbol_rows(pages).drop("position")


def file_imports(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["file_path", "extension", "content"]
    files = [V.source_files(spark, folder, name).select(columns) for name in V.SAMPLES]
    every = files[0]
    for more in files[1:]:
        every = every.unionAll(more)
    return O.with_structure(every).select("file_path", joined(F.col("imports")).alias("imports"))


def file_outline(spark: SparkSession, folder: str) -> DataFrame:
    found = O.file_outline(V.source_files(spark, folder, "typescript"))
    labels = F.transform("symbols", lambda s: F.concat_ws(" ", s["kind"], s["name"], s["lines"]))
    return found.select("file", "lines", joined(F.col("imports")).alias("imports"), joined(F.col("exports")).alias("exports"),
                        "symbols_count", joined(labels).alias("symbols"), joined(F.col("warnings")).alias("warnings"))


def symbol_source(spark: SparkSession, folder: str) -> DataFrame:
    files = V.source_files(spark, folder, "javascript")
    return O.symbol_source(files, F.concat(F.lit("use_part"), F.col("key").cast("string")), context=False)


def symbol_context(spark: SparkSession, folder: str) -> DataFrame:
    files = V.source_files(spark, folder, "typescript")
    found = O.symbol_source(files, F.concat(F.lit("plain"), F.col("key").cast("string")))
    lists = [joined(F.col(c)).alias(c) for c in ("imports", "exports", "siblings", "warnings")]
    return found.select("file", "symbol", "lines", "source", *lists)


def chunk_header(spark: SparkSession, folder: str) -> DataFrame:
    found = O.with_structure(V.source_files(spark, folder, "rust"))
    return found.select("file_path", X.chunk_header(F.col("file_path"), F.col("exports"), F.col("imports")).alias("header"))


# -- stored tables ----------------------------------------------------------------------------------


def _state_chunks(files: DataFrame) -> DataFrame:
    """Chunks of documents, as if embedded."""
    columns = files.select(F.col("relative_path").alias("file_path"), F.lit(".sql").alias("extension"), "content", F.md5("content").alias("hash"))
    return K.chunk_windows(columns).withColumn("vector", F.array(F.lit(0.0).cast("float")))


def _versions(spark: SparkSession, folder: str) -> tuple[ChunkStore, DataFrame, Written]:
    """A store after two runs, the changes the second one found, and its counts."""
    store = _store(spark, "versions")
    old = V.old_state(spark, folder)
    _put(store, _state_chunks(old), old.select("relative_path", F.lit("added").alias("change")))
    changed = settle(_changes(spark, folder).where("change <> 'unchanged'"))
    fresh = V.new_state(spark, folder).join(
        changed.where("change <> 'deleted'").select("relative_path"), "relative_path", "left_semi")
    return store, changed, _put(store, _state_chunks(fresh), changed)


def upsert_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Live rows after the second run, with the run that found each file as it is."""
    store, changed, _ = _versions(spark, folder)
    found_by = changed.select(F.col("relative_path").alias("file_path"), F.lit(2).alias("v"))
    rows = store.chunks().join(found_by, "file_path", "left")
    return rows.select("file_path", "name", "line_start", "line_end", F.md5("content").alias("content_md5"), F.coalesce("v", F.lit(1)).alias("v"))


def delete_by_path(spark: SparkSession, folder: str) -> DataFrame:
    store, old = _store(spark, "deleted"), V.old_state(spark, folder)
    _put(store, _state_chunks(old), old.select("relative_path", F.lit("added").alias("change")))
    _put(store, _state_chunks(old).where("false"), old.where("lang = 'fr'").select("relative_path", F.lit("deleted").alias("change")))
    return store.chunks().select("file_path", "name", "line_start", "line_end")


def _indexed(spark: SparkSession, folder: str) -> tuple[ChunkStore, list[Totals]]:
    """Documents as a tree of files, indexed by the tool; then every third file changed and every tenth removed, and indexed again."""
    root, embedder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}", HashingEmbedder(16)
    files = V.table(spark, folder, "documents").select("doc_id", F.expr("concat('src/', source, '/', doc_id, '.sql')").alias("relative_path"), F.col("text").alias("content"))
    V.write_tree(files, root)
    totals = [reindex(spark, root, embedder).totals]
    changed = F.when(F.col("doc_id") % 10 != 7, F.concat("content", F.lit("\nmore")))
    V.write_tree(files.where("doc_id % 3 = 0 OR doc_id % 10 = 7").withColumn("content", changed), root)
    return ChunkStore(spark, root), [*totals, reindex(spark, root, embedder).totals]


def index_state(spark: SparkSession, folder: str) -> DataFrame:
    """State rows after both runs, with the chunks that the store holds for each file."""
    store, _ = _indexed(spark, folder)
    held = store.chunks().groupBy(F.col("file_path").alias("relative_path")).agg(F.count("*").alias("stored"), F.count("vector").alias("embedded"))
    return store.meta().join(held, "relative_path", "full_outer").select(
        "relative_path", "hash", F.md5(joined(F.col("chunk_ids"))).alias("ids_md5"), "stored", "embedded")


def index_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What the tool reports for both runs."""
    _, totals = _indexed(spark, folder)
    rows = [(n, t.files_processed, t.chunks_created, t.files_deleted, t.chunks_embedded) for n, t in enumerate(totals, 1)]
    return spark.createDataFrame(rows, "run int, files_processed long, chunks_created long, files_deleted long, chunks_embedded long")


def meta_rollup(spark: SparkSession, folder: str) -> DataFrame:
    # Dealt by path before they are cut: cutting keeps that, so the grouping needs no shuffle of its own.
    by_path = lambda scan: scan.repartition("file_path")
    rows = C.meta_rows(K.chunk_windows(V.long_files(spark, folder, by_path)))
    return rows.select("relative_path", "hash", F.size("chunk_ids").alias("chunks"), F.md5(joined(F.col("chunk_ids"))).alias("ids_md5"))


def reindex_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the second run; those of chunks were taken while it wrote."""
    _, changed, written = _versions(spark, folder)
    return changed.agg(F.count_if(F.col("change").isin("added", "modified")).alias("files_processed"),
                       F.count_if(F.col("change") == "deleted").alias("files_deleted")).withColumn("chunks_created", F.lit(written.made))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        knn_search_code, knn_search_docs, knn_ext_postfilter, knn_batch, knn_cosine, preview, embed_documents, search_text,
        scan_filter, tree_source, categorise, file_tree, tree_stats, directory_counts, category_counts, content_hash, line_counts,
        change_detect, change_summary, deleted_paths, chunk_small, chunk_fixed, chunk_headings, chunk_symbols,
        chunk_dispatch, chunk_registered, warning_lines, html_outline, file_imports, file_outline, symbol_source, symbol_context,
        chunk_header, search_store, store_state, upsert_snapshot, delete_by_path, meta_rollup, reindex_totals, index_state, index_totals)
}
QUERIES["knn_ext_exact"] = partial(knn_ext_postfilter, exact=True)
QUERIES.update({f"symbols_{language}": partial(symbols, language) for language in V.SAMPLES})


def registered() -> dict[str, Query]:
    """The queries, each making the package importable in Python workers first."""

    def ready(query: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return query(spark, folder)
        return run

    return {name: ready(query) for name, query in QUERIES.items()}
