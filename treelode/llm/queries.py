"""The registered query of each operator over its whole table, with production parameters, and SQL where it can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.llm import (
    bpe, decontaminate, hard_negatives, imatch, interpolated_lm, lexical_search, license_scan, secret_spans, simhash, token_cache, token_files, toxicity, url_lists,
)
from treelode.llm.common import mounted, new_folder, read
from treelode.session import ship_package

TOKEN_LIMIT, END_ID = 1024, 1


def op1_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.edited_fingerprints(read(spark, folder, "documents"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.withColumn("fingerprint", simhash.as_hex(F.col("fingerprint")))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(read(spark, folder, "documents"), vocabulary, public_tokenizers.PATTERN)


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def captures_and_log(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures of all pages with a day of fetching, and list entries made of their hosts, domains and paths with days.

    Days come from page_id, as the tables have none; an entry's days come from the lowest page_id under its pattern.
    """
    day = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))
    url, n = F.col("url"), F.col("n")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", day(F.col("page_id") * 37 % 366).alias("fetched_at"))
    host, parts = url_lists.host_of(url), url_lists.path_parts(url)
    keyed = pages.where(host != "").select("page_id", host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
                                          F.concat(host, F.lit("/"), F.try_element_at(parts, F.lit(1))).alias("path"))

    def lowest(key: str) -> DataFrame:
        return keyed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pattern")).agg(F.min("page_id").alias("n"))

    def entries(name: str, key: str, step: int, factor: int, changes: list[tuple[int, bool]]) -> DataFrame:
        chosen = lowest(key).where(n % step == 0)
        dated = [F.struct(day(n * factor % 300 + after).alias("at"), F.lit(added).alias("added")) for after, added in changes]
        return chosen.select(F.lit(name).alias("list"), "pattern", F.explode(F.array(*dated)).alias("e")).select("list", "pattern", "e.at", "e.added")

    log = entries("hosts", "host", 2, 7, [(0, True), (40, False), (150, True)]).union(
        entries("domains", "domain", 5, 13, [(0, True), (90, False)])).union(
        entries("paths", "path", 3, 3, [(0, True), (100, False), (100, True), (120, True)])).union(
        entries("allow", "host", 11, 5, [(0, True)]))
    return captures, log


def op5_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    captures, log = captures_and_log(read(spark, folder, "pages"))
    return url_lists.judge(captures, url_lists.validity(log)).withColumnRenamed("capture_id", "page_id")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = mounted(new_folder(spark, "token-files"))
    token_files.write(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), files, END_ID)
    return token_files.read_back(spark, files)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_spans.secrets(read(spark, folder, "documents"))


def op9_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    return interpolated_lm.scores(read(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The cache starts empty here; a production run names a folder that stays."""
    docs, tokenizer = read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    counts = token_cache.token_counts(docs, tokenizer, new_folder(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licenses(read(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.whole_rows(rows, label))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_imatch, op2_simhash, op3_byte_bpe, op4_decontaminate, op5_url_lists, op6_token_files, op7_toxicity, op8_secrets, op9_interpolated_lm, op10_token_counts,
    op11_license_scan, op12_hard_negatives, op13_lexical_search,
)}
SQL: dict[str, str] = {
    "op4_decontaminate": r"""
WITH document AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM benchmark WHERE text IS NOT NULL),
starts AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM item WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, words[s:s + 9] AS span FROM starts),
widths AS (SELECT DISTINCT len(span) AS n FROM windows),
placed AS (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM document, widths),
occurring AS (SELECT r, s, n, item_id FROM (SELECT r, s, n, words[s:s + n - 1] AS span FROM placed) p JOIN windows USING (span)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM occurring) GROUP BY r),
owners AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM occurring WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM document LEFT JOIN hits USING (r) LEFT JOIN owners USING (r)""",
    "op5_url_lists": r"""
WITH capture AS (
  SELECT page_id AS capture_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS fetched_at,
         lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '')) AS host,
         list_filter(string_split(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/'), lambda x: x <> '') AS parts
  FROM pages),
keyed AS (
  SELECT capture_id AS n, 'host' AS kind, host AS pattern FROM capture WHERE host <> ''
  UNION ALL SELECT capture_id, 'domain', array_to_string(string_split(host, '.')[-2:], '.') FROM capture WHERE host <> ''
  UNION ALL SELECT capture_id, 'path', host || '/' || parts[1] FROM capture WHERE host <> '' AND len(parts) > 0),
lowest AS (SELECT kind, pattern, min(n) AS n FROM keyed GROUP BY ALL),
rule AS (FROM (VALUES ('hosts', 'host', 2, 7, 0, true), ('hosts', 'host', 2, 7, 40, false), ('hosts', 'host', 2, 7, 150, true),
                      ('domains', 'domain', 5, 13, 0, true), ('domains', 'domain', 5, 13, 90, false),
                      ('paths', 'path', 3, 3, 0, true), ('paths', 'path', 3, 3, 100, false), ('paths', 'path', 3, 3, 100, true),
                      ('paths', 'path', 3, 3, 120, true), ('allow', 'host', 11, 5, 0, true)) r(list, kind, step, factor, days, added)),
log AS (
  SELECT list, pattern, DATE '2024-01-01' + CAST(n * factor % 300 + days AS INT) AS at_day, added
  FROM lowest JOIN rule USING (kind) WHERE n % step = 0),
under AS (
  SELECT DISTINCT capture_id, fetched_at, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[:i], '/')))) AS pattern
  FROM capture WHERE host <> ''),
latest AS (
  SELECT capture_id, u.pattern, list, max(at_day) AS at_day
  FROM under u JOIN log l ON l.pattern = u.pattern AND l.at_day <= u.fetched_at GROUP BY ALL),
active AS (
  SELECT capture_id, list FROM latest JOIN log USING (pattern, list, at_day) GROUP BY capture_id, pattern, list HAVING bool_and(added)),
found AS (SELECT capture_id, count(*) AS n, list_sort(list_distinct(list(list))) AS names FROM active GROUP BY capture_id)
SELECT capture_id AS page_id, host, coalesce(n, 0) AS n_entries, coalesce(array_to_string(names, ','), '') AS lists,
       n IS NOT NULL AND NOT list_contains(names, 'allow') AS blocked
FROM capture LEFT JOIN found USING (capture_id)""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
    "op13_lexical_search": r"""
WITH document AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM documents),
item AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS q FROM item GROUP BY ALL),
total AS (SELECT count(*) AS n, CAST(sum(len(words)) AS BIGINT) AS l FROM document WHERE len(words) > 0),
posting AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(words) AS term FROM document) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM posting, total GROUP BY term, n),
length AS (SELECT r, 100 - 25 + (25 * len(words) * n) // l AS m FROM document, total WHERE len(words) > 0),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term) JOIN length USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in QUERIES.items()}


def statements() -> dict[str, str]:
    return dict(SQL)
