"""Near copies by the words themselves: texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more.

Three things propose pairs of distinct texts, and every link is checked on the shingles of both, so no chance match links anything:

* SimHash: fingerprints of five-word shingles within three bits of each other, from the covering of simhash.py.
* Min-hash bands choose the texts that can have a near copy at all: BANDS groups of ROWS minima each, and a text that shares no band
  with another is out. A pair of similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS, 0.99995 at 0.8 and more above.
* Prefixes pair these texts, exactly: with shingles in one order from rare to frequent, two similar texts of n and m shingles,
  n >= m, share one of the first n - ceil(0.8 n) + 1 of the one and the first m - ceil(8/9 m) + 1 of the other. Texts that only have
  passages in common part at once, as their own words are rarer.

A shingle with at most FEW texts gives its pairs of fitting sizes and places that nothing else connects. In a more frequent one, texts are compared with centres, once as
many centres in every round as before times four. Texts within the distance 0.2 of a centre are done, connected by it. By the triangle inequality only texts within 0.4 of
the centre can still be similar to one that is done. Those that links do not connect with the centre yet are compared with TRIES of
them first, as one link is enough, and, where none is found, with all of them. Before every round go the texts that fit no other one under the key which links do not
connect with them, so rounds end where no such pair is left, after the logarithm of the texts' number at most.

Shingle sets are made once for each distinct text, kept in the shared folder and joined by digest. Links of all rounds are appended to one
folder.

Defined results: A-Z count as a-z and words end at ASCII white space; a text of fewer words than a shingle is one shingle,
and null and blank texts are the empty one; rows that repeat id and text count once; an empty table gives an empty table; columns other
than doc_id and text are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelode.llm import simhash
from treelode.llm.common import new_folder, settled, slices, stored, texts_of, whole_text
from treelode.llm.simhash import components, first_of_each

WORDS, SIMILAR, BANDS, ROWS, FEW, TRIES, CENTRES_FACTOR = 5, 0.8, 25, 5, 64, 8, 4
FACTORS, SHIFTS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)
LINK, EDGE = "a bigint, b bigint, similar double", "a bigint, b bigint"


def shingles_of(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    found = text.encode().lower().split()
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    spans = zip(starts[:len(found) - WORDS + 1].tolist(), ends[WORDS - 1:].tolist())
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b]) for a, b in spans], np.uint64))


def bands_of(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band, different between bands."""
    least = np.full(len(FACTORS), ~np.uint64(0))
    for first in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[first:first + 1024, None] * FACTORS + SHIFTS).min(0))
    return [xxhash.xxh64_intdigest(part.tobytes(), n) - (1 << 63) for n, part in enumerate(least.reshape(BANDS, ROWS))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


# -- texts that may have a near copy ----------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(whole_text().alias("text"), F.xxhash64(whole_text()).alias("digest"))


def banded(docs: DataFrame) -> DataFrame:
    """(digest): texts that share a band with another text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [bands_of(shingles_of(text)) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(keys, pa.list_(pa.int64()))], ["digest", "buckets"])

    found = stored(_texts(docs).mapInArrow(rows, "digest bigint, buckets array<bigint>").dropDuplicates(["digest"]), "near-bands")
    dealt = found.select(F.explode("buckets").alias("bucket"), "digest")
    # Of a bucket only its ends are needed to tell whether it has two texts; they are found before the shuffle.
    shared = dealt.groupBy("bucket").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("bucket")
    return dealt.join(shared, "bucket", "left_semi").select("digest").distinct()


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """(a, b): texts of one fingerprint with the least of them, and of linked fingerprints the least of each."""
    prints = settled(simhash.fingerprints(docs, WORDS).select("digest", "fingerprint").distinct())
    least = prints.groupBy("fingerprint").agg(F.min("digest").alias("least"))
    within = prints.join(least, "fingerprint").where("digest <> least").select(F.col("least").alias("a"), F.col("digest").alias("b"))
    near = simhash.links(least.select("fingerprint"), 3)
    named = least.withColumnRenamed("least", "digest")
    across = near.join(named.withColumnsRenamed({"fingerprint": "a", "digest": "left"}), "a").join(named.withColumnsRenamed({"fingerprint": "b", "digest": "right"}), "b")
    return within.union(across.select(F.col("left").alias("a"), F.col("right").alias("b")))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, n, shingles), one row for each wanted digest; stored."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles_of(text).view(np.int64) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                             ["digest", "n", "shingles"])

    return stored(_texts(docs).join(wanted, "digest", "left_semi").dropDuplicates(["digest"]).mapInArrow(rows, "digest bigint, n bigint, shingles array<bigint>"), "near-sets")


# -- comparison -------------------------------------------------------------------------------------------------------


def compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similar) of distinct pairs of digests, from both sets of shingles; stored."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            found = [similarity(left[n].values.to_numpy(zero_copy_only=False).view(np.uint64), right[n].values.to_numpy(zero_copy_only=False).view(np.uint64))
                     for n in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similar"])

    # Spark knows the size of a stored table: where the pairs are few it broadcasts them, and only the sets they name are shuffled.
    pairs = stored(pairs.distinct(), "near-pairs")
    named = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest")))
    sets = stored(sets.select("digest", "shingles").join(named, "digest", "left_semi"), "near-named")
    side = lambda key, name: sets.select(F.col("digest").alias(key), F.col("shingles").alias(name))
    both = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")
    return stored(both.select("a", "b", "left", "right").mapInArrow(rows, LINK), "near-compared")


def shared_prefixes(sets: DataFrame) -> DataFrame:
    """(key, digest, n, place, short): texts under each shingle of their prefixes that another text has too; stored.

    `place` counts the shingles before it in the order from rare to frequent; `short` is whether it is in the shorter prefix.
    """
    shingles = sets.select("digest", "n", F.explode("shingles").alias("key"))
    counts = shingles.groupBy("key").count().where("count > 1")
    ordered = Window.partitionBy("digest").orderBy("count", "key")
    # A text's shingles that no other text has come first of all.
    placed = shingles.join(counts, "key").withColumns({"rank": F.row_number().over(ordered), "rest": F.count("*").over(Window.partitionBy("digest"))})
    placed = placed.withColumn("place", F.col("n") - F.col("rest") + F.col("rank") - 1)
    needed = lambda share: F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9))
    kept = placed.where(F.col("place") <= needed(SIMILAR)).select(
        "key", "digest", "n", "place", (F.col("place") <= needed(2 * SIMILAR / (1 + SIMILAR))).alias("short"))
    kept = stored(kept, "near-prefixes")
    useful = kept.groupBy("key").agg(F.count("*").alias("size"), F.max("short").alias("some")).where("size > 1 and some").select("key", "size")
    return stored(kept.join(useful, "key"), "near-keys")


def fits(x: str, y: str) -> Column:
    """Whether two texts can be similar if the key is the first shingle that their prefixes share."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place"))
    sized = (n >= m * F.lit(SIMILAR) - 1e-9) & (m >= n * F.lit(SIMILAR) - 1e-9)
    return (F.col(f"{x}.short") | F.col(f"{y}.short")) & sized & (most >= (n + m) * F.lit(SIMILAR / (1 + SIMILAR)) - 1e-9)


def undecided(rest: DataFrame) -> DataFrame:
    """Texts under a key that fit another one there which links do not connect with them; no pair is made for that.

    Two texts fit only where neither has more shingles than the other allows. So a text asks, of those in order of size up to what it allows itself, whether one
    of another root allows its own size. Roots are numbered within a key; two of them differ in some bit, so a running maximum for each value of each bit tells.
    """
    allows = (F.col("n") - F.col("place")) * F.lit((1 + SIMILAR) / SIMILAR) - F.col("n") + F.lit(1e-6)
    rows = stored(rest.withColumns({"allows": allows, "nth": F.dense_rank().over(Window.partitionBy("key").orderBy("root")) - 1}), "near-roots")
    bits = (rows.agg(F.max("nth")).first()[0] or 0).bit_length()
    if not bits:
        return rest.where("false")
    bit = lambda b: F.shiftright("nth", b).bitwiseAND(1)
    seen = rows.select("*", F.col("n").cast("double").alias("at"), F.lit(False).alias("asks")).union(rows.select("*", F.col("allows").alias("at"), F.lit(True).alias("asks")))
    before = Window.partitionBy("key").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    most = {f"most{b}_{v}": F.max(F.when(~F.col("asks") & (bit(b) == v), F.col("allows"))).over(before) for b in range(bits) for v in (0, 1)}
    fitting = [F.when(bit(b) == 0, F.col(f"most{b}_1")).otherwise(F.col(f"most{b}_0")) >= F.col("n") for b in range(bits)]
    return seen.withColumns(most).where(F.col("asks") & reduce(Column.__or__, [F.coalesce(found, F.lit(False)) for found in fitting])).select(*rest.columns)


def pair_of(x: str, y: str) -> list[Column]:
    x, y = F.col(f"{x}.digest"), F.col(f"{y}.digest")
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def prefix_links(sets: DataFrame, rest: DataFrame, folder: str, few: int, tries: int) -> int:
    """Appends links between the texts of keys, by centres where there are more than `few`; returns the number of rounds.

    Keys of few texts come last, when most of their texts are connected already.
    """
    centres_of_round, rounds, spark = 1, 0, sets.sparkSession
    rest, small = rest.withColumn("root", F.col("digest")), []
    while True:
        rest = stored(undecided(rest).withColumn("left", F.count("*").over(Window.partitionBy("key"))), "near-rest")
        small.append(rest.where(F.col("left") <= few).drop("left", "root"))
        large = rest.where(F.col("left") > few).drop("left")
        if large.isEmpty():
            break
        rounds += 1
        order = Window.partitionBy("key").orderBy(F.desc("short"), F.xxhash64("digest", F.lit(rounds)))
        centres = large.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= centres_of_round) & F.col("short"))
        met = centres.select("key", F.col("digest").alias("centre")).join(large.drop("root"), "key").where("centre <> digest")
        met = met.select("key", "centre", F.least("centre", "digest").alias("a"), F.greatest("centre", "digest").alias("b"), "digest", "n", "place", "short")
        found = compared(sets, met.select("a", "b"))
        found.where(F.col("similar") >= SIMILAR).select("a", "b").write.mode("append").parquet(folder)
        known = stored(met.join(found, ["a", "b"]).drop("a", "b"), "near-met")
        done = known.where(F.col("similar") >= SIMILAR)
        near = known.where((F.col("similar") < SIMILAR) & (F.col("similar") >= 2 * SIMILAR - 1 - 1e-9))
        # Of these, only what the links so far do not connect with the centre anyway.
        linked = components(spark.read.schema(EDGE).parquet(folder))
        of = lambda node, root: linked.select(F.col("node").alias(node), F.col("root").alias(root))
        near = near.join(of("digest", "own"), "digest", "left").join(of("centre", "its"), "centre", "left")
        near = stored(near.where(F.coalesce("own", "digest") != F.coalesce("its", "centre")).drop("own", "its"), "near-apart")
        some = done.withColumn("rank", F.row_number().over(Window.partitionBy("key", "centre").orderBy(F.xxhash64("digest", F.lit(-rounds))))).where(F.col("rank") <= tries)
        tried = near.alias("y").join(some.alias("x"), ["key", "centre"]).select("key", "centre", F.col("y.digest").alias("digest"), *pair_of("x", "y"))
        tried = stored(tried, "near-tried")
        outcome = compared(sets, tried.select("a", "b")).where(F.col("similar") >= SIMILAR).select("a", "b")
        outcome.write.mode("append").parquet(folder)
        reached = tried.join(outcome, ["a", "b"], "left_semi").select("key", "centre", "digest").distinct()
        unreached = near.join(reached, ["key", "centre", "digest"], "left_anti")
        _append(sets, unreached.alias("y").join(done.alias("x"), ["key", "centre"]).where(fits("x", "y")).select(*pair_of("x", "y")), folder)
        gone = done.select("key", "digest").union(centres.select("key", "digest")).distinct()
        rest = large.drop("root").join(gone, ["key", "digest"], "left_anti").join(of("digest", "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        centres_of_round *= CENTRES_FACTOR
    linked = components(spark.read.schema(EDGE).parquet(folder)).withColumnRenamed("node", "digest")
    few_texts = reduce(DataFrame.unionByName, small).join(linked, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    _append(sets, small_pairs(stored(few_texts, "near-few")), folder)
    return rounds


def small_pairs(rest: DataFrame) -> DataFrame:
    """All pairs that fit under keys of few texts, but for those that other links connect."""
    return rest.alias("x").join(rest.alias("y"), "key").where("x.digest < y.digest AND x.root <> y.root").where(fits("x", "y")).select(*pair_of("x", "y"))


def _append(sets: DataFrame, pairs: DataFrame, folder: str) -> None:
    compared(sets, pairs).where(F.col("similar") >= SIMILAR).select("a", "b").write.mode("append").parquet(folder)


# -- groups -----------------------------------------------------------------------------------------------------------


def links(docs: DataFrame, few: int = FEW, tries: int = TRIES) -> tuple[DataFrame, int]:
    """(a, b): pairs of text digests of SIMILAR or more that connect the same texts as all such pairs do; and the rounds it took."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "near-links")
    proposed = stored(fingerprint_pairs(docs), "near-fingerprints")
    candidates = stored(banded(docs), "near-candidates")
    wanted = candidates.union(proposed.select("a")).union(proposed.select("b")).distinct()
    sets = shingle_sets(docs, wanted)
    _append(sets, proposed, folder)
    rounds = prefix_links(sets, shared_prefixes(sets.join(candidates, "digest", "left_semi")).drop("size"), folder, few, tries)
    return spark.read.schema(EDGE).parquet(folder), rounds


def groups(docs: DataFrame, few: int = FEW) -> DataFrame:
    """doc_id, digest of the text, and root: the least digest reachable over links."""
    linked = components(links(docs, few)[0]).withColumnRenamed("node", "digest")
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("digest"))
    return rows.join(linked, "digest", "left").select("doc_id", "digest", F.coalesce("root", "digest").alias("root"))


def one_of_each(docs: DataFrame, few: int = FEW) -> DataFrame:
    """One row of each group, with all its columns: of those with the smallest doc_id, the one of least text digest."""
    return first_of_each(docs, groups(docs, few))
