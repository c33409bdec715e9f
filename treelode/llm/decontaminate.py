"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Words are runs of ASCII letters (A-Z count as a-z), digits and non-ASCII characters. Every distinct window of benchmark
words, 10 consecutive ones or all of a shorter item, has two anchors: the positions in it of its rarest and second rarest
word, by the counts of benchmark words in all documents. The index stores a posting (term, document, position) for each
occurrence of an anchor. Postings of the rarest term give where a window would have to start; subtracting the offset
of the second anchor from its postings gives the same for that one, and the join of the two keeps the starts on which
both agree. What is left is compared with the words of the document at that place, for all words of the window.

A document is named by doc_id (0 for none) and a digest of its text, so repeated ids do not mix. Spark broadcasts the windows and terms
while they are under its broadcast threshold and shuffles beyond it; no term list is collected.

Defined results: null and wordless texts have no words, no hits and no windows; items without words match nothing; items
that repeat count by item_id; repeated documents each have a row; an empty benchmark leaves everything clean; an empty
documents table gives an empty table; null item ids are not counted as items; other columns are not looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import ascii_lower, stored, whole_text

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ("doc_key", "digest")


def parts_of(text: Column) -> Column:
    """The words in order, with an empty string before or after them where the text begins or ends with a separator."""
    return F.split(ascii_lower(text), SEPARATORS)


def words_of(text: Column) -> Column:
    return F.array_remove(parts_of(text), "")


def key_columns() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(0)).alias("doc_key"), F.xxhash64(whole_text()).alias("digest")]


def keyed_words(docs: DataFrame) -> DataFrame:
    """doc_key, digest and words of every row; empty strings at the ends match no term and shift all places alike."""
    return docs.select(*key_columns(), parts_of(whole_text()).alias("words"))


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """item_id and window (array of words), one row for each distinct window of an item."""
    words = items.select("item_id", words_of(whole_text()).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    cut = words.select("item_id", "words", F.explode(starts).alias("start"))
    return cut.select("item_id", F.slice("words", F.col("start") + 1, width).alias("window")).distinct()


def postings(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_key, digest, position) of every occurrence of the given terms (distinct rows of `term`)."""
    placed = words.select(*KEY, F.posexplode("words").alias("position", "term"))
    return placed.join(terms, "term").select("term", *KEY, "position")


def term_counts(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents, 0 for a term without any."""
    found = words.select(F.explode("words").alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, first, second): term and offset of the rarest and second rarest word; a single word is both."""
    placed = windows.select("window", F.posexplode("window").alias("offset", "term")).join(counts, "term")
    ranked = placed.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by_n"))
    first, second = F.col("by_n")[0], F.coalesce(F.try_element_at("by_n", F.lit(2)), F.col("by_n")[0])
    return ranked.where(first["n"] > 0).select("window", first.alias("first"), second.alias("second"))


def phrase_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_key, digest, found): for documents in which windows occur, the distinct (start, window) of every occurrence.

    `windows` has distinct rows of `window`, an array of words. Counting and indexing are two scans of the documents,
    checking a third; two small jobs run at once.
    """
    words = keyed_words(docs)
    terms = windows.select(F.explode("window").alias("term")).distinct()
    anchors = stored(anchored(windows, term_counts(words, terms)), "anchors")
    wanted = anchors.select("first.term").union(anchors.select("second.term")).distinct()
    index = stored(postings(words, wanted), "postings")
    starts = index.join(anchors, F.col("term") == F.col("first.term")).select(
        *KEY, "window", "second", (F.col("position") - F.col("first.offset")).alias("start")).where("start >= 0")
    second = index.select(*KEY, F.col("term").alias("second_term"), F.col("position").alias("second_position"))
    agreed = starts.withColumns({"second_term": F.col("second.term"), "second_position": F.col("start") + F.col("second.offset")})
    agreed = agreed.join(second, [*KEY, "second_term", "second_position"], "left_semi")
    candidates = agreed.groupBy(*KEY).agg(F.collect_set(F.struct("start", "window")).alias("candidates"))
    texts = docs.select(*key_columns(), whole_text().alias("text")).join(candidates, [*KEY])
    # The transform over one array names the words: they are cut once per document and not once per candidate.
    same = F.transform(F.array(parts_of(F.col("text"))), lambda words: F.filter(
        "candidates", lambda c: F.slice(words, c["start"] + 1, F.size(c["window"])) == c["window"]))[0]
    checked = texts.select(*KEY, same.alias("found")).where(F.size("found") > 0)
    return checked.dropDuplicates([*KEY])


def proximity_matches(docs: DataFrame, windows: DataFrame, within: int) -> DataFrame:
    """(doc_key, digest, window, position): occurrences of a window's rarest word that have all its other words, in any
    order, at most `within` words away. Needs postings of all words of the windows.
    """
    words = keyed_words(docs)
    terms = windows.select(F.explode("window").alias("term")).distinct()
    anchors = stored(anchored(windows, term_counts(words, terms)), "anchors")
    index = stored(postings(words, terms), "postings")
    needed = F.array_distinct("window")
    around = index.join(anchors, F.col("term") == F.col("first.term")).select(
        *KEY, "window", F.col("position").alias("anchor"), F.size(needed).alias("needed"), F.explode(needed).alias("term"))
    near = around.join(index, [*KEY, "term"]).where(F.abs(F.col("position") - F.col("anchor")) <= within)
    counted = near.groupBy(*KEY, "window", "anchor", "needed").agg(F.countDistinct("term").alias("n"))
    return counted.where("n = needed").select(*KEY, "window", F.col("anchor").alias("position"))


def _covered(spans: Column) -> Column:
    """How many positions the union of sorted (start, stop) spans has."""
    step = lambda held, span: F.struct(
        (held["n"] + F.greatest(span["stop"] - F.greatest(span["start"], held["stop"]), F.lit(0))).alias("n"),
        F.greatest(held["stop"], span["stop"]).alias("stop"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
    return F.aggregate(spans, zero, step, lambda held: held["n"].cast("bigint"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of the documents."""
    by_item = windows_of(items, width)
    found = stored(phrase_matches(docs, by_item.select("window").distinct()), "matches")
    spans = F.transform("found", lambda f: F.struct(f["start"].alias("start"), (f["start"] + F.size(f["window"])).alias("stop")))
    hits = found.select(*KEY, _covered(F.array_sort(spans)).alias("n_hit"))
    matched = found.select(*KEY, F.explode(F.array_distinct(F.transform("found", lambda f: f["window"]))).alias("window"))
    owners = matched.join(by_item, "window").select(*KEY, "item_id").where("item_id is not null").distinct()
    listed = owners.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    counted = docs.select("doc_id", *key_columns(), F.size(words_of(whole_text())).cast("bigint").alias("n_words"))
    joined = counted.join(hits, [*KEY], "left").join(listed, [*KEY], "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows in which no window of the benchmark occurs, with all their columns."""
    found = stored(phrase_matches(docs, windows_of(items, width).select("window").distinct()), "matches").select(*KEY)
    named = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), *key_columns())
    return named.join(found, [*KEY], "left_anti").select("row.*")
