"""The registered queries in plain SQL, written apart from the Spark code: window functions and joins
instead of array expressions, and line numbers of the sample sources stated instead of parsed."""
from __future__ import annotations

from treelode.checks import views as V
from treelode.checks.queries import EMBED_DIMENSIONS, QUERY_ID, QUERY_STEP, SEARCH_TEXT

NL = "chr(10)"

CHUNKS = f"""
chunks AS (
  SELECT vec_id, 'c' || vec_id AS id,
    'src/m' || (vec_id % 20) || '/f' || vec_id || CASE vec_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.py'
      WHEN 3 THEN '.go' ELSE '.md' END AS file_path,
    CASE WHEN label < 2 THEN 'doc_section' WHEN label < 5 THEN 'function' WHEN label < 8 THEN 'class' ELSE 'hook' END AS chunk_type,
    's' || label AS name, vec_id % 40 + 1 AS line_start, vec_id % 40 + 1 + vec_id % 7 AS line_end, embedding
  FROM embeddings),
content_lines AS (
  SELECT vec_id, i, CASE WHEN i % 4 = 0 THEN '// note ' || i ELSE 'row ' || i END AS line
  FROM (SELECT vec_id, unnest(range(1, vec_id % 12 + 4)) AS i FROM embeddings)),
contents AS (
  SELECT vec_id, '// File: f' || vec_id || {NL} || {NL} || string_agg(line, {NL} ORDER BY i) AS content FROM content_lines GROUP BY vec_id),
previews AS (
  SELECT vec_id, {NL} || string_agg(line, {NL} ORDER BY i) AS preview
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS r FROM content_lines WHERE line NOT LIKE '//%')
  WHERE r <= 7 GROUP BY vec_id)"""


def _distance(query: str) -> str:
    return (f"list_sum(list_transform(list_zip(c.embedding, {query}), "
            "lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))")


NEAR = CHUNKS + f""",
near AS (
  SELECT c.*, {_distance('q.embedding')} AS d FROM chunks c, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID}) q)"""
SIX = "floor({} * 1e6 + 0.5) / 1e6"
SCORE = "floor((1 - d) * 100 + 0.5) / 100"


def _ranked(where: str, limit: int) -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY d, file_path, line_start, id) AS rank FROM near WHERE {where} "
            f"QUALIFY rank <= {limit}")


_SQL: dict[str, str] = {}

_SQL["knn_search_code"] = f"""WITH {NEAR}, best AS ({_ranked("chunk_type <> 'doc_section'", 10)})
SELECT rank, file_path AS file, name, chunk_type AS type, line_start || '-' || line_end AS lines, {SCORE} AS score, preview
FROM best JOIN previews USING (vec_id)"""

_SQL["knn_search_docs"] = f"""WITH {NEAR}, best AS ({_ranked("chunk_type = 'doc_section'", 5)})
SELECT rank, file_path AS file, name AS section, line_start || '-' || line_end AS lines, {SCORE} AS score, content
FROM best JOIN contents USING (vec_id)"""

_EXT = "(file_path LIKE '%.py' OR file_path LIKE '%.go')"
_SQL["knn_ext_postfilter"] = f"""WITH {NEAR}, best AS ({_ranked("chunk_type <> 'doc_section'", 30)})
SELECT row_number() OVER (ORDER BY rank) AS rank, file_path AS file, {SIX.format('d')} AS distance
FROM best WHERE {_EXT} QUALIFY row_number() OVER (ORDER BY best.rank) <= 10"""

_SQL["knn_ext_exact"] = f"""WITH {NEAR}, best AS ({_ranked(f"chunk_type <> 'doc_section' AND {_EXT}", 10)})
SELECT rank, file_path AS file, {SIX.format('d')} AS distance FROM best"""

_SQL["knn_batch"] = f"""WITH {CHUNKS}, pairs AS (
  SELECT q.vec_id AS query_id, c.*, {_distance('q.embedding')} AS d
  FROM chunks c, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % {QUERY_STEP} = 0) q)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, file_path, line_start, id) AS rank,
  id AS chunk_id, {SIX.format('d')} AS distance
FROM pairs QUALIFY rank <= 10"""

_SQL["knn_cosine"] = f"""WITH {CHUNKS}, pairs AS (
  SELECT q.vec_id AS query_id, c.*, 1 - list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d
  FROM chunks c, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % {QUERY_STEP} = 0) q WHERE c.chunk_type = 'doc_section')
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 12), file_path, line_start, id) AS rank,
  id AS chunk_id, {SIX.format('d')} AS distance
FROM pairs QUALIFY rank <= 5"""

_SQL["search_store"] = f"""WITH {NEAR}, best AS (
  SELECT *, row_number() OVER (ORDER BY d, file_path, line_start, id) AS rank FROM near
  WHERE chunk_type <> 'doc_section' AND vec_id % 10 <> 7 QUALIFY rank <= 2000)
SELECT rank, file_path AS file, {SIX.format('d')} AS distance, md5(content) AS content_md5 FROM best JOIN contents USING (vec_id)"""

_SQL["store_state"] = f"""WITH {CHUNKS}
SELECT file_path AS relative_path, md5(content) AS hash, id AS ids, md5(content) AS content_md5
FROM chunks JOIN contents USING (vec_id) WHERE vec_id % 10 <> 7"""

_SQL["preview"] = f"""WITH {NEAR}
SELECT id AS chunk_id, {SCORE} AS score, preview FROM near JOIN previews USING (vec_id)"""

_POSITION = f"CAST(('0x' || substr(md5({{}}), 1, 8)) AS BIGINT) % {EMBED_DIMENSIONS}"
_EMBEDDED = f"""
words AS (SELECT 'docs/' || source || '/' || lang || '/' || doc_id || '.md' AS file,
  unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents),
cells AS (SELECT file, {_POSITION.format('word')} AS slot, count(*)::DOUBLE AS c FROM words GROUP BY ALL),
vectors AS (SELECT file, slot, c / sqrt(sum(c * c) OVER (PARTITION BY file)) AS x FROM cells)"""

_SQL["embed_documents"] = f"""WITH {_EMBEDDED}
SELECT file, count(*) AS filled, round(max(x), 4) AS largest, CAST(arg_min(slot, {{a: -x, b: slot}}) + 1 AS INTEGER) AS largest_at
FROM vectors GROUP BY file"""

_SQL["search_text"] = f"""WITH {_EMBEDDED},
query_cells AS (SELECT {_POSITION.format('word')} AS slot, count(*)::DOUBLE AS c FROM (
  SELECT unnest(string_split('{SEARCH_TEXT}', ' ')) AS word) GROUP BY ALL),
query AS (SELECT slot, c / sqrt(sum(c * c) OVER ()) AS y FROM query_cells),
near AS (SELECT file, 2 - 2 * coalesce(sum(x * y), 0) AS d FROM vectors LEFT JOIN query USING (slot) GROUP BY file)
SELECT row_number() OVER (ORDER BY round(d, 9), file) AS rank, file, round(d, 4) AS distance FROM near QUALIFY rank <= 10"""

# -- scan and tree ----------------------------------------------------------------------------------

_SHAPES = "[" + ", ".join(f"'{s}'" for s in V.PATH_SHAPES) + "]"
_SHAPED = f"""shaped AS (SELECT doc_id % {len(V.PATH_SHAPES)} AS shape, replace(({_SHAPES})[doc_id % {len(V.PATH_SHAPES)} + 1],
  '%s', doc_id::VARCHAR) AS relative_path FROM documents)"""
_EXTENSION = "'.' || split_part(relative_path, '.', -1)"
# Shapes that pass: plain code, .mdx, the re-included folder, a capital root, an underscore name, a kept .sql.
_SQL["scan_filter"] = f"""WITH {_SHAPED}
SELECT relative_path, {_EXTENSION} AS extension, CASE WHEN relative_path LIKE '%.mdx' THEN 'docs' ELSE 'code' END AS category
FROM shaped WHERE shape IN (0, 5, 10, 13, 15)"""

_SQL["categorise"] = f"""WITH {_SHAPED}, typed AS (SELECT {_EXTENSION} AS extension FROM shaped)
SELECT extension, CASE WHEN extension IN ('.md', '.mdx') THEN 'docs'
  WHEN extension IN ('.ts', '.js', '.py', '.go', '.json', '.css', '.tsx', '.sql') THEN 'code' END AS category, count(*) AS files
FROM typed GROUP BY ALL"""

_PROJECT = """project AS (
  SELECT 'docs/' || source || '/' || lang AS dir, doc_id || '.md' AS file FROM documents
  UNION ALL SELECT 'src/pages', page_id || '.html' FROM pages)"""
_SQL["file_tree"] = f"WITH {_PROJECT} SELECT dir, file FROM project"
_SQL["tree_stats"] = f"""WITH {_PROJECT}
SELECT count(*) AS total_files, count(*) FILTER (file LIKE '%.html') AS code_files, count(*) FILTER (file LIKE '%.md') AS doc_files,
  string_agg(DISTINCT '.' || split_part(file, '.', -1), '|' ORDER BY '.' || split_part(file, '.', -1)) AS languages FROM project"""
_SQL["directory_counts"] = f"WITH {_PROJECT} SELECT dir, count(*) AS files FROM project GROUP BY dir"
_SQL["category_counts"] = f"""WITH {_PROJECT}
SELECT CASE WHEN file LIKE '%.md' THEN 'docs' ELSE 'code' END AS category, count(*) AS files FROM project GROUP BY 1"""

# -- change detection -------------------------------------------------------------------------------

_DOCS = "docs AS (SELECT lang, source, 'docs/' || source || '/' || lang || '/' || doc_id || '.md' AS relative_path, text FROM documents)"
_SQL["content_hash"] = f"WITH {_DOCS} SELECT relative_path, sha256(text) AS hash FROM docs"
_SQL["line_counts"] = f"WITH {_DOCS} SELECT relative_path, 1 + length(text) - length(replace(text, {NL}, '')) AS lines FROM docs"
_CHANGED = f"""{_DOCS}, changed AS (
  SELECT relative_path, lang, source, text, CASE WHEN source = 'src5' THEN 'deleted' WHEN lang = 'de' THEN 'added'
    WHEN source IN ('src2', 'src9') THEN 'modified' ELSE 'unchanged' END AS change
  FROM docs WHERE NOT (source = 'src5' AND lang = 'de'))"""
_SQL["change_detect"] = f"WITH {_CHANGED} SELECT relative_path, change FROM changed"
_SQL["change_summary"] = f"""WITH {_CHANGED}
SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified,
  count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change <> 'unchanged') AS total FROM changed"""
_SQL["deleted_paths"] = f"WITH {_DOCS} SELECT relative_path FROM docs WHERE source = 'src5' AND lang <> 'de'"

# -- chunking ---------------------------------------------------------------------------------------


def _windows(files: str, base: str) -> str:
    """CTEs from `files` (file_path, content) to `windows`; small files stay whole."""
    return f"""{files},
lines AS (SELECT file_path, sha256(content) AS hash, unnest(string_split(content, {NL})) AS line,
  generate_subscripts(string_split(content, {NL}), 1) AS n, len(string_split(content, {NL})) AS total FROM files),
windows AS (
  SELECT file_path, hash, total, w AS ordinal, min(n) AS line_start, max(n) AS line_end, string_agg(line, {NL} ORDER BY n) AS body,
    CASE WHEN total <= 50 THEN {base} ELSE {base} || ':' || min(n) || '-' || max(n) END AS name
  FROM (SELECT *, (n - 1) // 200 AS w FROM lines) GROUP BY file_path, hash, total, w)"""


_LONG = """files AS (SELECT 'db/' || source || '/' || doc_id || '.sql' AS file_path,
  repeat(text || chr(10), doc_id % 8) || text AS content FROM documents)"""
_BASE = "split_part(file_path, '/', -1)"
_ID = "sha256(file_path || chr(0) || hash || chr(0) || ordinal || chr(0) || line_start || '-' || line_end)"
_WINDOW_ROWS = f"""SELECT {_ID} AS id, file_path, 'module' AS chunk_type, name,
  md5('// File: ' || file_path || {NL} || {NL} || body) AS content_md5, line_start, line_end FROM windows"""
_SQL["chunk_fixed"] = f"WITH {_windows(_LONG, _BASE)} {_WINDOW_ROWS}"
_SQL["chunk_small"] = f"WITH {_windows(_LONG, _BASE)} {_WINDOW_ROWS} WHERE total <= 50"

# Sections as gaps and islands over line rows.
_HEADED = rf"""
raw AS (SELECT doc_id, 'docs/' || source || '/' || doc_id || '.md' AS file_path, unnest(string_split(text, {NL})) AS line,
  generate_subscripts(string_split(text, {NL}), 1) - 1 AS i FROM documents),
marked AS (SELECT file_path, i, CASE WHEN i % 13 = 4 THEN '### ' || chr(9) || ' ' || line || '  '
  WHEN (i + doc_id) % 5 = 0 THEN '# ' || line WHEN i % 7 = 3 THEN '#### ' || line WHEN i % 11 = 6 THEN '##' || line
  WHEN i % 9 = 8 THEN '   ' ELSE line END AS line FROM raw),
file_hash AS (SELECT file_path, sha256(string_agg(line, {NL} ORDER BY i)) AS hash FROM marked GROUP BY file_path),
flagged AS (SELECT *, i > 0 AND regexp_matches(line, '^#{{1,3}}\s+.') AS opens FROM marked),
islands AS (SELECT *, sum(opens::INT) OVER (PARTITION BY file_path ORDER BY i) AS section FROM flagged),
sections AS (SELECT file_path, section, min(i) + 1 AS line_start, max(i) + 1 AS line_end,
    trim(string_agg(line, {NL} ORDER BY i), ' ' || chr(9) || {NL}) AS body,
    CASE WHEN section = 0 THEN {_BASE} ELSE trim(regexp_replace(arg_min(line, i), '^#+\s+', '')) END AS name
  FROM islands GROUP BY file_path, section),
numbered AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY section) - 1 AS ordinal
  FROM sections JOIN file_hash USING (file_path) WHERE body <> '')"""
_SQL["chunk_headings"] = f"""WITH {_HEADED}
SELECT {_ID} AS id, file_path, 'doc_section' AS chunk_type, name,
  md5('// File: ' || file_path || {NL} || '// Section: ' || name || {NL} || {NL} || body) AS content_md5, line_start, line_end
FROM numbered"""

_SQL["warning_lines"] = f"""
SELECT 'src/' || doc_id || '.py' AS file_path, 'L' || (i + 1) || ': ' || CASE i % 7 WHEN 0 THEN 'TODO ' WHEN 1 THEN 'note: '
  WHEN 2 THEN 'FIXME ' ELSE '@Deprecated ' END || line AS warning
FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) - 1 AS i FROM documents)
WHERE i % 7 < 4"""

# -- structure --------------------------------------------------------------------------------------

_PARTS = "parts AS (SELECT p_partkey::VARCHAR AS k, greatest(coalesce(p_size, 1), 1) AS n FROM part)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _path(language: str) -> str:
    return f"replace({_quoted(V.SAMPLES[language].path)}, '@K', k)"


def _symbol_cte(language: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT k, n, {_path(language)} AS file_path, {at} AS position, {name} AS name, '{kind}' AS kind, {a} AS line_start, {b} AS line_end FROM parts"
        for at, (name, kind, a, b) in enumerate(V.SAMPLES[language].symbols))
    return f"{_PARTS}, symbols AS ({rows})"


def _text_cte(language: str) -> str:
    """Lines of the sample files as rows."""
    sample = V.SAMPLES[language]
    before, _, after = sample.text.partition("@FILL")

    def fixed(text: str) -> str:
        return f"replace(replace({_quoted(text)}, '@K', k), '@N', n::VARCHAR)"

    fill = f"(SELECT string_agg(replace({_quoted(sample.filler)}, '@I', i::VARCHAR), {NL} ORDER BY i) FROM (SELECT unnest(range(1, n + 1)) AS i))"
    return f"""fills AS (SELECT n, {fill} AS fill FROM (SELECT DISTINCT n FROM parts)),
texts AS (SELECT k, n, {_path(language)} AS file_path, {fixed(before)} || fill || {fixed(after)} AS content FROM parts JOIN fills USING (n)),
text_lines AS (SELECT k, n, file_path, unnest(string_split(content, {NL})) AS line, generate_subscripts(string_split(content, {NL}), 1) AS i FROM texts)"""


def _names(language: str, separator: str) -> str:
    return f" || '{separator}' || ".join(name for name, *_ in V.SAMPLES[language].symbols)


def _modules(language: str, separator: str) -> str:
    return f" || '{separator}' || ".join(V.SAMPLES[language].imports) or "''"


for _language in V.SAMPLES:
    _SQL[f"symbols_{_language}"] = f"WITH {_symbol_cte(_language)} SELECT file_path, position, name, kind, line_start, line_end FROM symbols"

_SQL["html_outline"] = f"""SELECT 'src/pages/' || page_id || '.html' AS file_path, 'html' AS name, 'element' AS kind, 1 AS line_start,
  1 + length(html) - length(replace(html, {NL}, '')) AS line_end FROM pages"""

_SQL["file_imports"] = f"WITH {_PARTS} " + " UNION ALL ".join(
    f"SELECT {_path(name)} AS file_path, {_modules(name, '|')} AS imports FROM parts" for name in V.SAMPLES)

_TS = V.SAMPLES["typescript"]
_TS_FIXED = _TS.text.replace("@FILL\n", "").count("\n") + 1
_LABEL = "kind || ' ' || name || ' ' || line_start || '-' || line_end"
_SQL["file_outline"] = f"""WITH {_symbol_cte('typescript')}
SELECT file_path AS file, n + {_TS_FIXED} AS lines, any_value({_modules('typescript', '|')}) AS imports,
  any_value({_names('typescript', '|')}) AS exports, count(*) AS symbols_count, string_agg({_LABEL}, '|' ORDER BY position) AS symbols,
  any_value('L' || (n + {_TS_FIXED} - 1) || ': TODO sort by ' || k) AS warnings
FROM symbols GROUP BY file_path, n"""

_SQL["symbol_source"] = f"""WITH {_symbol_cte('javascript')}, {_text_cte('javascript')}
SELECT file_path AS file, name AS symbol, line_start || '-' || line_end AS lines, string_agg(line, {NL} ORDER BY i) AS source
FROM symbols JOIN text_lines USING (file_path) WHERE position = 0 AND i BETWEEN line_start AND line_end GROUP BY ALL"""

_SQL["symbol_context"] = f"""WITH {_symbol_cte('typescript')}, others AS (
  SELECT file_path, string_agg(kind || ' ' || name || ' (' || line_start || '-' || line_end || ')', '|' ORDER BY position) AS siblings
  FROM symbols WHERE name <> 'plain' || k GROUP BY file_path)
SELECT file_path AS file, name AS symbol, line_start || '-' || line_end AS lines, 'class plain' || k || ' {{}}' AS source,
  {_modules('typescript', '|')} AS imports, {_names('typescript', '|')} AS exports, siblings,
  'L' || (n + {_TS_FIXED} - 1) || ': TODO sort by ' || k AS warnings
FROM symbols JOIN others USING (file_path) WHERE name = 'plain' || k"""

_SQL["chunk_header"] = f"""WITH {_PARTS}
SELECT {_path('rust')} AS file_path, '// File: ' || {_path('rust')} || {NL} || '// Exports: ' || {_names('rust', ', ')} || {NL} ||
  '// Imports: ' || {_modules('rust', ', ')} AS header FROM parts"""

_PY_FIXED = V.SAMPLES["python"].text.replace("@FILL\n", "").count("\n") + 1
_HEAD = (f"'// File: ' || file_path || {NL} || '// Exports: ' || {_names('python', ', ')} || {NL} || "
         f"'// Imports: ' || {_modules('python', ', ')} || {NL} || {NL}")
_SQL["chunk_symbols"] = f"""WITH {_symbol_cte('python')}, {_text_cte('python')},
spans AS (
  SELECT k, n, file_path, position, name, kind, line_start, line_end FROM symbols WHERE n + {_PY_FIXED} > 50
  UNION ALL SELECT k, n, file_path, 0, {_BASE}, 'module', 1, n + {_PY_FIXED} FROM texts WHERE n + {_PY_FIXED} <= 50)
SELECT file_path, kind AS chunk_type, name, md5({_HEAD} || string_agg(line, {NL} ORDER BY i)) AS content_md5, line_start, line_end
FROM spans JOIN text_lines USING (k, n, file_path) WHERE i BETWEEN line_start AND line_end
GROUP BY k, n, file_path, position, name, kind, line_start, line_end"""

_GO_FIXED = V.SAMPLES["go"].text.replace("@FILL\n", "").count("\n") + 1
_SQL["chunk_dispatch"] = f"""WITH {_windows(_LONG, _BASE)}, {_HEADED}, {_symbol_cte('go')},
every AS (
  SELECT 'module' AS chunk_type, line_start, line_end FROM windows
  UNION ALL SELECT 'doc_section', line_start, line_end FROM numbered
  UNION ALL SELECT kind, line_start, line_end FROM symbols WHERE n + {_GO_FIXED} > 50
  UNION ALL SELECT 'module', 1, n + {_GO_FIXED} FROM parts WHERE n + {_GO_FIXED} <= 50)
SELECT chunk_type, line_start, line_end, count(*) AS chunks FROM every GROUP BY ALL"""

_SQL["tree_source"] = """
SELECT 'docs/' || source || '/' || lang || '/' || doc_id || '.md' AS relative_path, '.md' AS extension, octet_length(encode(text)) AS size,
  sha256(text) AS hash, md5(text) AS content_md5
FROM documents WHERE lang IN ('de', 'en')"""

_SQL["chunk_registered"] = f"""WITH {_LONG},
raw AS (SELECT file_path, unnest(string_split(content, {NL})) AS line, generate_subscripts(string_split(content, {NL}), 1) AS n FROM files)
SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY n) - 1 AS INT) AS ordinal, 'L' || n AS name,
  CAST(n AS INT) AS line_start, CAST(n AS INT) AS line_end, md5(line) AS body_md5
FROM raw WHERE trim(line, ' ') <> ''"""

# -- stored tables ----------------------------------------------------------------------------------

_STATE = f"""{_CHANGED}, files AS (
  SELECT relative_path AS file_path, CASE WHEN source IN ('src2', 'src9') AND change <> 'added' AND {{old}} THEN text || {NL} || 'old' ELSE text END AS content,
    CASE WHEN change IN ('added', 'modified') THEN 2 ELSE 1 END AS v FROM changed WHERE {{where}})"""
_SQL["upsert_snapshot"] = f"""WITH {_windows(_STATE.format(old='false', where="change <> 'deleted'"), _BASE)}
SELECT file_path, name, line_start, line_end, md5('// File: ' || file_path || {NL} || {NL} || body) AS content_md5, v
FROM windows JOIN (SELECT file_path, v FROM files) USING (file_path)"""
_SQL["delete_by_path"] = f"""WITH {_windows(_STATE.format(old='true', where="lang NOT IN ('de', 'fr')"), _BASE)}
SELECT file_path, name, line_start, line_end FROM windows"""
_SQL["meta_rollup"] = f"""WITH {_windows(_LONG, _BASE)}
SELECT file_path AS relative_path, hash, count(*) AS chunks, md5(string_agg({_ID}, '|' ORDER BY line_start)) AS ids_md5
FROM windows GROUP BY file_path, hash"""
_SQL["reindex_totals"] = f"""WITH {_windows(_STATE.format(old='false', where="change IN ('added', 'modified')"), _BASE)}
SELECT (SELECT count(*) FROM changed WHERE change IN ('added', 'modified')) AS files_processed,
  (SELECT count(*) FROM changed WHERE change = 'deleted') AS files_deleted, (SELECT count(*) FROM windows) AS chunks_created"""


_TREE = """files AS (SELECT doc_id, 'src/' || source || '/' || doc_id || '.sql' AS file_path,
  text || CASE WHEN {changed} THEN chr(10) || 'more' ELSE '' END AS content FROM documents WHERE {where})"""
_SECOND = _TREE.format(changed="doc_id % 3 = 0", where="doc_id % 10 <> 7")
_SQL["index_state"] = f"""WITH {_windows(_SECOND, _BASE)}
SELECT file_path AS relative_path, hash, md5(string_agg({_ID}, '|' ORDER BY line_start)) AS ids_md5, count(*) AS stored, count(*) AS embedded
FROM windows GROUP BY file_path, hash"""
_SQL["index_totals"] = f"""
SELECT 1 AS run, (SELECT count(*) FROM documents) AS files_processed,
  (WITH {_windows(_TREE.format(changed='false', where='true'), _BASE)} SELECT count(*) FROM windows) AS chunks_created, 0 AS files_deleted,
  (WITH {_windows(_TREE.format(changed='false', where='true'), _BASE)} SELECT count(*) FROM windows) AS chunks_embedded
UNION ALL SELECT 2, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 10 <> 7),
  (WITH {_windows(_TREE.format(changed='true', where='doc_id % 3 = 0 AND doc_id % 10 <> 7'), _BASE)} SELECT count(*) FROM windows),
  (SELECT count(*) FROM documents WHERE doc_id % 10 = 7),
  (WITH {_windows(_TREE.format(changed='true', where='doc_id % 3 = 0 AND doc_id % 10 <> 7'), _BASE)} SELECT count(*) FROM windows)"""


def statements() -> dict[str, str]:
    return dict(_SQL)
