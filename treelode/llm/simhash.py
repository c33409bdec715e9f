"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

Every bit position i has a vector m(i) of radius + 1 bits. Table v, one for each of the 2^(radius + 1) - 1 non-zero vectors,
keeps the positions i where m(i) and v have an odd inner product. The vectors of at most `radius` differing positions
leave some v orthogonal to all of them, so two fingerprints within the radius agree on everything that table v keeps.

Only distinct fingerprints are hashed, so copies cost one row. A bucket of more than BUCKET_ROWS fingerprints is dealt
anew, exactly: the positions its table ignores are cut into radius + 1 pieces, of which two linked fingerprints share
one, and each piece makes a bucket of its own. Every level ignores fewer positions, so the last one has at most
BUCKET_ROWS fingerprints by construction. A bucket gives a spanning forest of its links instead of all pairs; components
come from alternating star contraction over those links, in rounds that are written to the shared folder.

Defined results: null and blank texts have fingerprint 0 and are linked like any other; a text of fewer words than a
shingle is one shingle; repeated rows each have a row; the component of rows without any doc_id is null; an empty
table gives an empty table; columns other than doc_id and text are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelode.llm.common import settled, slices, texts_of, whole_text

BITS = 64
BUCKET_ROWS = 4096
LINKS_PER_TASK = 1 << 17
NO_ID = (1 << 63) - 1


def fingerprint_of(text: str, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint. A-Z count as a-z; words end at ASCII white space."""
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(words, len(found))
    spans = zip(starts[: len(found) - width + 1].tolist(), ends[width - 1:].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
    votes = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, a digest of the text, and fingerprint (signed 64 bits) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint_of(text, words, seed) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(found, pa.int64())], schema.names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("digest", T.LongType()),
                           T.StructField("fingerprint", T.LongType())])
    return docs.select("doc_id", "text", F.xxhash64(whole_text()).alias("digest")).mapInArrow(rows, schema)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


# -- covering ---------------------------------------------------------------------------------------------------------


def covering_masks(radius: int) -> list[int]:
    """The positions that each table keeps."""
    tables = 2 ** (radius + 1) - 1
    vectors = [i % tables + 1 for i in range(BITS)]
    return [sum(1 << i for i, vector in enumerate(vectors) if (vector & v).bit_count() % 2) for v in range(1, tables + 1)]


def split_mask(mask: int, radius: int) -> list[int]:
    """A mask for each piece of the ignored positions: the positions kept before, and that piece."""
    ignored = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in ignored[p::radius + 1]) for p in range(radius + 1)]


def _literal(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def _dealt(rows: DataFrame, masks: list[Column], label: Column) -> DataFrame:
    """A row (label, key, fingerprint) for each of the masks."""
    keys = F.array(*[F.struct((label * len(masks) + n).alias("label"), F.col("fingerprint").bitwiseAND(mask).alias("key"))
                     for n, mask in enumerate(masks)])
    return rows.select(F.explode(keys).alias("b"), "fingerprint").select("b.label", "b.key", "fingerprint")


def buckets(distinct: DataFrame, radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(label, key, fingerprint): every pair of fingerprints within the radius shares a label and key.

    Where buckets were dealt anew, two buckets of different levels may bear the same label and key; links are checked
    by distance, so that adds comparisons and no link.
    """
    masks = covering_masks(radius)
    rows, done = _dealt(distinct, [_literal(m) for m in masks], F.lit(0)), None
    while True:
        if all(2 ** (BITS - m.bit_count()) <= bucket_rows for m in masks):
            break
        sizes = rows.groupBy("label", "key").count()
        large = settled(sizes.where(F.col("count") > bucket_rows).select("label", "key"))
        if large.isEmpty():
            break
        small = rows.join(large, ["label", "key"], "left_anti")
        done = small if done is None else done.union(small)
        pieces = [split_mask(m, radius) for m in masks]
        chosen = [F.element_at(F.array(*[_literal(p[n]) for p in pieces]), F.col("label") + 1) for n in range(radius + 1)]
        rows = _dealt(rows.join(large, ["label", "key"], "left_semi"), chosen, F.col("label"))
        masks = [mask for p in pieces for mask in p]
    return rows if done is None else done.union(rows)


def forest(values: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest of the values within the radius of each other; no pair is held."""
    left, right = [], []
    rest = values
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            value = front.pop()
            near = np.bitwise_count(rest ^ value) <= radius
            if near.any():
                reached, rest = rest[near], rest[~near]
                left.append(np.full(len(reached), value))
                right.append(reached)
                front.extend(reached)
    return left, right


def links(distinct: DataFrame, radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b), a < b: links within the radius that connect the same fingerprints as all such links do."""
    rows = buckets(distinct, radius, bucket_rows).repartition("label", "key").sortWithinPartitions("label", "key")

    def of_runs(label: np.ndarray, key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        fresh = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (key[1:] != key[:-1]))))
        sizes = np.diff(np.concatenate((fresh, [len(value)])))
        first, second = value[fresh[sizes == 2]], value[fresh[sizes == 2] + 1]
        near = np.bitwise_count(first ^ second) <= radius
        left, right = [first[near]], [second[near]]
        for start, size in zip(fresh[sizes > 2], sizes[sizes > 2]):
            more = forest(value[start:start + size], radius)
            left += more[0]
            right += more[1]
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(n).to_numpy() for n in range(3)]
            held = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
            label, key, value = held
            last = np.flatnonzero((label != label[-1]) | (key != key[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last run may go on in the next batch
            if cut:
                yield of_runs(label[:cut], key[:cut], value[:cut].view(np.uint64))
            held = [column[cut:] for column in held]
        if held is not None:
            yield of_runs(held[0], held[1], held[2].view(np.uint64))

    return rows.mapInArrow(of_partition, "a bigint, b bigint").distinct()


# -- components -------------------------------------------------------------------------------------------------------


def _summary(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is the smallest node that it reaches.

    Large star and small star in turn until nothing changes; each round is one small table in the shared folder.
    """
    edges = settled(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _summary(edges)
    while True:
        # Tasks by the number of links: few links in many partitions would cost more files than rows.
        tasks = max(1, -(-before[0] // LINKS_PER_TASK))
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a and low <> b").select(F.col("low").alias("a"), "b").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("low").alias("a"))
        edges = settled(small.where("a <> b").select("a", "b").coalesce(tasks).distinct().coalesce(tasks))
        after = _summary(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def groups(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, digest, fingerprint and root: the least fingerprint reachable over links within the radius."""
    prints = settled(fingerprints(docs, words, seed))
    distinct = settled(prints.select("fingerprint").distinct())
    linked = components(links(distinct, radius, bucket_rows)).withColumnRenamed("node", "fingerprint")
    return prints.join(linked, "fingerprint", "left").select(
        "doc_id", "digest", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint (signed), component_id: the smallest doc_id reachable over links within the radius."""
    grouped = settled(groups(docs, radius, words, seed, bucket_rows))
    lowest = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(lowest, "root").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """One row of each group, with all its columns: of those with the smallest doc_id, the one of least text digest."""
    return first_of_each(docs, groups(docs, radius, words, seed))


def first_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of each root of (doc_id, digest, root), with all columns of docs."""
    keys = [F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.col("digest")]
    kept = grouped.select(*keys, "root").groupBy("root").agg(F.min(F.struct("key", "digest")).alias("k"))
    named = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64(whole_text()).alias("digest"))
    found = named.join(kept.select("k.key", "k.digest"), ["key", "digest"], "left_semi")
    first = F.row_number().over(Window.partitionBy("key", "digest").orderBy("key")) == 1  # repeated rows are alike in id and text
    return found.withColumn("first", first).where("first").select("row.*")
