"""Ranked lexical search of documents for every item, by dual-tree search.

Documents and items are vectors over the items' terms: a document's coordinate is what one occurrence of the term in an item
adds to its score per unit of weight, an item's is weight times occurrences. A tree over either side holds, in every node, the
greatest value of each coordinate below it, so the inner product of two nodes bounds every score between them. A pair of
nodes is dropped with all its documents and items where that bound is below the weakest k-th score of the node's items; only pairs of
leaves that remain are scored. The bound is never less than a score, so the result is exact, ties included.

Items are dealt to batches of about BATCH_TERMS terms and BATCH_BYTES of them, one batch in most uses; a batch is what a task holds of
the items. For each, one scan writes n and the counts of the batch's terms for each document to the shared folder, Spark counts N, L and
the documents of each term over it, and a second scan of those counts builds trees over SLICE_CELLS cells at a time and searches
them. A task passes on the first k documents of each item; ranks come from those.

Defined results: null, empty and wordless texts have no terms, match nothing and do not count as documents; items without
terms, or whose terms occur nowhere, have no rows; items that repeat item_id and text have all their rows again; repeated documents
are documents each; a null doc_id comes after all others among equal scores; empty tables give an empty table; columns
other than item_id, doc_id and text are not looked at.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from treelode.llm.common import new_folder, settled, slices, stored, texts_of, whole_text
from treelode.llm.decontaminate import words_of

BATCH_TERMS, BATCH_BYTES = 1 << 16, 16 << 20
SLICE_CELLS = 1 << 24
FAN, LEAF_ITEMS = 16, 8
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (A-Z as a-z), digits and non-ASCII characters, in UTF-8."""
    return text.encode().translate(TERM_BYTES).split()


# -- counts -----------------------------------------------------------------------------------------------------------


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n, and the numbers and counts of the given terms, of every document that has any term; stored."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            ns, numbers, counts = [], [], []
            for text in texts_of(batch):
                found = terms_of(text)
                ns.append(len(found))
                tally = Counter(found)
                both = sorted((known[term], tally[term]) for term in tally.keys() & known.keys())
                numbers.append([number for number, _ in both])
                counts.append([count for _, count in both])
            made = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(numbers, pa.list_(pa.int32())),
                                               pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])
            yield made.filter(pa.array(np.array(ns, np.int64) > 0))

    return stored(docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"), "term-counts")


class Corpus:
    """N, L and the weight of each term number, over all documents."""

    def __init__(self, index: DataFrame, size: int):
        total = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        self.n, self.l = total.n, total.l
        self.weights = np.zeros(size, np.int64)
        # One row for each term of the batch, which is bounded.
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            self.weights[row.term] = math.floor(1000 * math.log((2 * self.n + 2) / (2 * row["count"] + 1)))

    def coordinates(self, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What a term that occurs `counts` times in a document of n terms adds per unit of weight."""
        m = 100 - 25 + 25 * n * self.n // self.l
        return 1_000_000_000 * counts // (1000 * counts + 12 * m)


# -- trees ------------------------------------------------------------------------------------------------------------


class Items:
    """A node of the tree over items first to last: its terms and their greatest coordinates; leaves have all coordinates."""

    def __init__(self, vectors: list[dict[int, int]], first: int):
        self.first, self.last = first, first + len(vectors)
        self.terms = np.array(sorted(set().union(*vectors)), np.int64)
        if len(vectors) <= LEAF_ITEMS:
            self.parts = []
            self.values = np.array([[v.get(term, 0) for term in self.terms.tolist()] for v in vectors], np.int64).reshape(len(vectors), len(self.terms))
            self.greatest = self.values.max(0)
        else:
            size = LEAF_ITEMS
            while size * FAN < len(vectors):
                size *= FAN
            self.parts = [Items(vectors[n:n + size], first + n) for n in range(0, len(vectors), size)]
            self.greatest = np.zeros(len(self.terms), np.int64)
            for part in self.parts:
                places = np.searchsorted(self.terms, part.terms)
                self.greatest[places] = np.maximum(self.greatest[places], part.greatest)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of two matrices of non-negative integers, the second one of at most a million each."""
    if a.size and int(a.sum(-1).max()) * 1_000_000 < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b.astype(np.int64)


class Documents:
    """A tree over a slice of documents: levels[0] has their coordinates, each further level the maxima of FAN nodes."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int, n_terms: int):
        self.levels = [np.zeros((n_terms, size), np.float32)]  # a million at most, exact in 24 bits
        self.levels[0][terms, rows] = values
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    def under(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes below the given ones, a level down."""
        found = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return found[found < self.levels[level - 1].shape[1]]


class Best:
    """The first k documents of each item: highest score, then lowest doc_id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.kth = k, np.zeros(items, np.int64)
        empty = np.zeros(0, np.int64)
        self.kept = [(empty, empty, empty) for _ in range(items)]

    def add(self, item: int, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        score, doc_id, null = (np.concatenate(pair) for pair in zip(self.kept[item], (score, doc_id, null)))
        order = np.lexsort((doc_id, null, -score))[:self.k]
        self.kept[item] = score[order], doc_id[order], null[order]
        if len(order) == self.k:
            self.kth[item] = score[order[-1]]


def visit(node: Items, tree: Documents, level: int, nodes: np.ndarray, best: Best, doc_id: np.ndarray, null: np.ndarray) -> None:
    """Score what may be among the first k of any item below `node`, in the documents below `nodes`."""
    bound = inner(node.greatest[None, :], tree.levels[level][node.terms][:, nodes])[0]
    nodes = nodes[(bound > 0) & (bound >= best.kth[node.first:node.last].min())]
    if not len(nodes):
        return
    if level or node.parts:
        below = tree.under(level, nodes) if level else nodes
        for part in node.parts or [node]:
            visit(part, tree, max(level - 1, 0), below, best, doc_id, null)
        return
    scores = inner(node.values, tree.levels[0][node.terms][:, nodes])
    for n, row in enumerate(scores):
        hits = np.flatnonzero((row > 0) & (row >= best.kth[node.first + n]))
        if len(hits):
            best.add(node.first + n, row[hits], doc_id[nodes[hits]], null[nodes[hits]])


def searched(index: DataFrame, corpus: Corpus, vectors: list[dict[int, int]], names: pa.RecordBatch, k: int, schema: str) -> DataFrame:
    """(item, item_id, copies, doc_id, score): the first k documents of each item in each partition, for items named by rows of `names`."""
    n_terms = len(corpus.weights)
    root = index.sparkSession.sparkContext.broadcast(Items(vectors, 0))
    slice_docs = max(FAN, SLICE_CELLS // max(n_terms, 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(vectors), k)
        for batch in batches:
            for start in range(0, batch.num_rows, slice_docs):
                part = batch.slice(start, slice_docs)
                sizes = np.diff(part.column("terms").offsets.to_numpy())
                terms = part.column("terms").flatten().to_numpy().astype(np.int64)
                if not len(terms):
                    continue
                values = corpus.coordinates(np.repeat(part.column("n").to_numpy(), sizes), part.column("counts").flatten().to_numpy())
                # Documents with the same heaviest term stand together, so that few nodes have it.
                heaviest = np.zeros(part.num_rows, np.int64)
                some = np.flatnonzero(sizes)
                heaviest[some] = np.maximum.reduceat(corpus.weights[terms] * n_terms + terms, (np.cumsum(sizes) - sizes)[some])
                order = np.argsort(heaviest, kind="stable")
                place = np.empty(part.num_rows, np.int64)
                place[order] = np.arange(part.num_rows)
                tree = Documents(np.repeat(place, sizes), terms, values, part.num_rows, n_terms)
                doc_id = part.column("doc_id").fill_null(0).to_numpy()[order]
                null = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)[order].astype(np.int64)
                visit(root.value, tree, len(tree.levels) - 1, np.zeros(1, np.int64), best, doc_id, null)
        for item, (score, doc_id, null) in enumerate(best.kept):
            if len(score):
                own = names.take(pa.array([item] * len(score))).columns
                yield pa.RecordBatch.from_arrays([*own, pa.array(doc_id, mask=null > 0), pa.array(score)], [*names.schema.names, "doc_id", "score"])

    return index.mapInArrow(rows, schema)


# -- all items --------------------------------------------------------------------------------------------------------


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of every item."""
    spark = docs.sparkSession
    item_type = items.schema["item_id"].dataType
    schema = f"item bigint, item_id {item_type.simpleString()}, copies bigint, doc_id bigint, score bigint"
    tallied = items.select("item_id", words_of(whole_text()).alias("words")).groupBy("item_id", "words").agg(F.count("*").alias("copies"))
    tallied = settled(tallied.where(F.size("words") > 0))
    size = tallied.agg(F.sum(F.size(F.array_distinct("words"))).alias("terms"), F.sum(F.length(F.array_join("words", " "))).alias("bytes")).first()
    batches = max(1, -(-(size.terms or 0) // batch_terms), -(-(size.bytes or 0) // BATCH_BYTES))
    dealt = tallied.withColumn("batch", F.pmod(F.xxhash64("item_id", "words"), F.lit(batches)))
    folder = new_folder(spark, "lexical-search")
    spark.createDataFrame([], schema).write.parquet(folder)
    for batch in range(batches):
        held = dealt.where(F.col("batch") == batch).collect()  # about batch_terms terms
        if not held:
            continue
        numbers = {term.encode(): n for n, term in enumerate(sorted({word for row in held for word in row.words}))}
        index = counted(docs, numbers)
        corpus = Corpus(index, len(numbers))

        def vector(words: list[str]) -> dict[int, int]:
            return {n: count * int(corpus.weights[n]) for n, count in Counter(numbers[word.encode()] for word in words).items()}

        # Items that share their lightest terms stand together: these make most of a bound.
        held = sorted(((vector(row.words), row) for row in held), key=lambda pair: sorted((int(corpus.weights[n]), n) for n in pair[0])[:4])
        names = pa.RecordBatch.from_arrays(
            [pa.array([(batch << 32) + n for n in range(len(held))], pa.int64()), pa.array([row.item_id for _, row in held], to_arrow_type(item_type)),
             pa.array([row.copies for _, row in held], pa.int64())], ["item", "item_id", "copies"])
        searched(index, corpus, [found for found, _ in held], names, k, schema).write.mode("append").parquet(folder)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = spark.read.schema(schema).parquet(folder).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return first.select("item_id", "rank", "doc_id", "score", copy.alias("copy")).drop("copy")
