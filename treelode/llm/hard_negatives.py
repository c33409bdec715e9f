"""Hard-negative mining over Parquet blocks in Hilbert-curve order, chosen by zone maps.

Index: vectors of integers are sorted by label and by their place on a Hilbert curve through a coarse grid of all dimensions, and cut
into blocks of BLOCK_ROWS rows, one Parquet row each. A block's zone map has the least and greatest value of every dimension
and of the label. Up to CHUNK_BLOCKS blocks that follow each other form a chunk, the unit that anchors are sent to.

Search: interval arithmetic over a zone map gives the least and greatest score that any row of the block can have with an anchor. Anchors
meet pages of zone maps, and are sent to the chunks in which a block's interval touches one of their score windows; there only
those blocks are multiplied. For positives the window begins at the anchor's fifth best score in its own block, for
negatives the windows are those of its positives. Both sides are dealt by page or chunk and streamed in order, so a task
holds one page of zone maps or one chunk of blocks, whatever the number of anchors. Anchors and rows grow together, so the work of an
exact search grows faster than its input wherever bounds do not part blocks.

Defined results: rows with a null vec_id, label or vector or a null or non-finite component take no part; missing components of
shorter vectors are 0; a row with the anchor's vec_id is neither its positive nor its negative; rows that repeat are
candidates each, and one anchor; components saturate at 64 bits and scores beyond 64 bits wrap; an anchor without positives or a positive without negatives
has no rows; an empty table gives an empty table; columns other than vec_id, label and embedding are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelode.llm.common import stored

BLOCK_ROWS, CHUNK_BLOCKS, PAGE_BLOCKS = 512, 64, 1024
CURVE_BITS = 2
LEAST, MOST = -(1 << 63), (1 << 63) - 1
ANCHORS_AT_ONCE = 1024
PART = "akey bigint, anchor_id bigint, label bigint, vector binary, windows array<struct<lo: bigint, hi: bigint>>"


def whole_rows(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v has floor(scale * x) of every component x."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & F.coalesce(usable, F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint"), label.cast("bigint").alias("label"),
                       F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


# -- the curve --------------------------------------------------------------------------------------------------------


def curve_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of grid cells, one row each with `bits` bits a dimension, as keys that sort in bytes."""
    axes = cells.T.astype(np.uint32).copy()
    top = 1 << (bits - 1)
    step = top
    while step > 1:  # undo the reflections and rotations of the coarser cells
        low = np.uint32(step - 1)
        for axis in axes:
            swap = (axes[0] ^ axis) & low
            inverted = (axis & np.uint32(step)) != 0
            axes[0] ^= np.where(inverted, low, swap)
            axis ^= np.where(inverted, np.uint32(0), swap)
        step >>= 1
    axes = np.bitwise_xor.accumulate(axes, axis=0)  # Gray code
    last, turn, step = axes[-1], np.zeros(axes.shape[1], np.uint32), top
    while step > 1:
        turn ^= np.where(last & np.uint32(step), np.uint32(step - 1), np.uint32(0))
        step >>= 1
    axes ^= turn
    planes = [(axes >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    matrix = np.zeros((len(column), width), np.int64)
    matrix[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return matrix


# -- the index --------------------------------------------------------------------------------------------------------


class Shape:
    """Facts of the whole table: rows, width, range of components."""

    def __init__(self, rows: DataFrame):
        found = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"),
                         F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
        self.n, self.width, self.lo, self.hi = found.n, max(found.width or 0, 1), min(found.lo or 0, 0), max(found.hi or 0, 0)
        fits = [code for code in ("<i2", "<i4", "<i8") if np.iinfo(code).min <= self.lo and self.hi <= np.iinfo(code).max]
        self.code = fits[0]

    def cells(self, matrix: np.ndarray) -> np.ndarray:
        part = (matrix.astype(np.float64) - self.lo) / (float(self.hi) - self.lo + 1)
        return np.minimum(part * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1).astype(np.uint32)

    def matrix(self, values: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(values), self.code).reshape(-1, self.width)


def index(rows: DataFrame, shape: Shape) -> DataFrame:
    """Blocks as stored rows: chunk, block, n, label_lo, label_hi, lo, hi (per dimension), ids, labels, vectors."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    chunk_blocks = max(1, min(CHUNK_BLOCKS, shape.n // (BLOCK_ROWS * 3 * parallel)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = padded(batch.column("v"), shape.width)
            vectors = [row.tobytes() for row in matrix.astype(shape.code)]
            keys = curve_keys(shape.cells(matrix), CURVE_BITS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())],
                ["vec_id", "label", "key", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(_rebatched(batches, BLOCK_ROWS)):
            labels, matrix = batch.column("label").to_numpy(), shape.matrix(batch.column("vector").to_pylist())
            row = {"chunk": first + number // chunk_blocks, "block": first + number, "n": batch.num_rows,
                   "label_lo": int(labels.min()), "label_hi": int(labels.max()),
                   "lo": matrix.min(0).tobytes(), "hi": matrix.max(0).tobytes(),
                   "ids": batch.column("vec_id").to_numpy().tobytes(), "labels": labels.tobytes(), "vectors": matrix.tobytes()}
            yield pa.RecordBatch.from_pylist([row])

    order = ["label", "key", "vec_id"]
    dealt = rows.mapInArrow(keyed, "vec_id bigint, label bigint, key binary, vector binary").repartitionByRange(*order)
    blocks = dealt.sortWithinPartitions(*order).select("vec_id", "label", "vector").mapInArrow(
        cut, "chunk bigint, block bigint, n bigint, label_lo bigint, label_hi bigint, lo binary, hi binary, ids binary, labels binary, vectors binary")
    return stored(blocks, "hard-negative-blocks")


def _rebatched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of exactly `size` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# -- scores -----------------------------------------------------------------------------------------------------------


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; by floating point where that is exact."""
    most = [max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))) for m in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with anything in each box."""
    most = max(abs(int(m.min(initial=0))) + abs(int(m.max(initial=0))) for m in (anchors, lo, hi))
    if most * most * anchors.shape[1] >= 1 << 53:  # sums may leave 64 bits, where scores wrap: nothing is ruled out
        full = np.full((len(anchors), len(lo)), MOST)
        return ~full, full
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, lo) + product(down, hi), product(up, hi) + product(down, lo)


def first_of(owner: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each owner: by owner, highest score, lowest vec_id."""
    order = np.lexsort((vec_id, ~score, owner))
    ranked = owner[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]


def best(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first k fitting columns of every row."""
    rest = np.where(fits, scores, LEAST)
    if rest.shape[1] > k:
        fits = fits & (rest >= np.partition(rest, -k, axis=1)[:, -k, None])
    row, column = np.nonzero(fits)
    kept = first_of(row, scores[row, column], ids[column], k)
    return row[kept], column[kept]


# -- the search -------------------------------------------------------------------------------------------------------


def anchors_of(blocks: DataFrame, shape: Shape, step: int, k: int) -> DataFrame:
    """Anchors (akey, anchor_id, label, vector, windows): one window, from the k-th best score of the label in the own block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                matrix = shape.matrix([row["vectors"]])
                own = np.flatnonzero(ids % step == 0)
                if not len(own):
                    continue
                scores = product(matrix[own], matrix)
                same = (labels[own, None] == labels) & (ids[own, None] != ids)
                rest = np.where(same, scores, LEAST)
                lowest = np.partition(rest, -k, axis=1)[:, -k] if rest.shape[1] >= k else np.full(len(own), LEAST)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array(labels[own]), pa.array([v.tobytes() for v in matrix[own]], pa.binary()), pa.array(lowest)],
                    ["anchor_id", "label", "vector", "lowest"])

    found = blocks.select("ids", "labels", "vectors").mapInArrow(rows, "anchor_id bigint, label bigint, vector binary, lowest bigint")
    one = found.groupBy("anchor_id", "label", "vector").agg(F.max("lowest").alias("lowest"))
    window = F.array(F.struct(F.col("lowest").alias("lo"), F.lit(MOST).alias("hi")))
    return stored(one.select(F.xxhash64("anchor_id", "label", "vector").alias("akey"), "anchor_id", "label", "vector", window.alias("windows")), "anchors")


def _streamed(held: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Both sides dealt by a key; of each key the rows to hold come first."""
    first = held.select(key, F.lit(0).alias("kind"), F.struct(*[c for c in held.columns if c != key]).alias("held"))
    then = sent.select(key, F.lit(1).alias("kind"), F.struct(*[c for c in sent.columns if c != key]).alias("sent"))
    return first.unionByName(then, allowMissingColumns=True).repartition(key).sortWithinPartitions(key, "kind")


def _meetings(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict], list[dict]]]:
    """(key, rows held, up to ANCHORS_AT_ONCE rows sent), in the order of _streamed."""
    current, held = None, []
    for batch in batches:
        for start in range(0, batch.num_rows, ANCHORS_AT_ONCE):
            part = batch.slice(start, ANCHORS_AT_ONCE).to_pylist()
            sent: list[dict] = []
            for row in part:
                if row[key] != current:
                    if sent:
                        yield current, held, sent
                    current, held, sent = row[key], [], []
                if row["kind"] == 0:
                    held.append(row["held"])
                else:
                    sent.append(row["sent"])
            if sent:
                yield current, held, sent


def _windows(sent: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends, a row for each anchor; missing windows are empty."""
    most = max(len(row["windows"]) for row in sent)
    lo, hi = np.full((len(sent), most), MOST), np.full((len(sent), most), LEAST)
    for n, row in enumerate(sent):
        for m, window in enumerate(row["windows"]):
            lo[n, m], hi[n, m] = window["lo"], window["hi"]
    return lo, hi


def choose(blocks: DataFrame, anchors: DataFrame, shape: Shape, same_label: bool) -> DataFrame:
    """Anchors, once for each chunk that they must read, with the chunk and the blocks of it."""
    pages = max(1, -(-shape.n // (BLOCK_ROWS * PAGE_BLOCKS)))
    zones = blocks.select(F.pmod(F.xxhash64("chunk"), F.lit(pages)).cast("int").alias("page"), "chunk", "block", "label_lo", "label_hi", "lo", "hi")
    dealt = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"))
    columns = ["akey", "anchor_id", "label", "vector", "windows"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, sent in _meetings(batches, "page"):
            if not held:
                continue
            least, most = bounds(shape.matrix([row["vector"] for row in sent]), shape.matrix([z["lo"] for z in held]), shape.matrix([z["hi"] for z in held]))
            low, high = np.array([z["label_lo"] for z in held]), np.array([z["label_hi"] for z in held])
            label = np.array([row["label"] for row in sent])[:, None]
            useful = (low <= label) & (label <= high) if same_label else (low != label) | (high != label)
            lo, hi = _windows(sent)
            touched = np.zeros_like(useful)
            for n in range(lo.shape[1]):
                touched |= (most >= lo[:, n, None]) & (least <= hi[:, n, None])
            chunks, blocks_of = np.array([z["chunk"] for z in held]), np.array([z["block"] for z in held])
            found = []
            for n, row in enumerate(sent):
                places = np.flatnonzero(useful[n] & touched[n])
                for chunk in np.unique(chunks[places]).tolist():
                    found.append({c: row[c] for c in columns} | {"chunk": chunk, "blocks": blocks_of[places[chunks[places] == chunk]].tolist()})
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

    schema = pa.schema([("akey", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()),
                        ("windows", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("chunk", pa.int64()), ("blocks", pa.list_(pa.int64()))])
    return _streamed(zones, dealt, "page").mapInArrow(rows, f"{PART}, chunk bigint, blocks array<bigint>")


def search(blocks: DataFrame, anchors: DataFrame, shape: Shape, same_label: bool, k: int) -> DataFrame:
    """(akey, anchor_id, window, rank, vec_id, score): the first k rows of the same or of other labels in each window."""
    sent = choose(blocks, anchors, shape, same_label)
    names = ["akey", "anchor_id", "window", "vec_id", "score"]

    def of_block(held: dict, matrix: np.ndarray, label: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        """Anchor's place, window, vec_id and score of what one block has for the given anchors."""
        ids, labels = np.frombuffer(held["ids"], "<i8"), np.frombuffer(held["labels"], "<i8")
        scores = product(matrix, shape.matrix([held["vectors"]]))
        usable = ((label[:, None] == labels) == same_label) & (own[:, None] != ids)
        parts = []
        for n in range(lo.shape[1]):
            row, column = best(scores, usable & (scores >= lo[:, n, None]) & (scores <= hi[:, n, None]), ids, k)
            parts.append([row, np.full(len(row), n), ids[column], scores[row, column]])
        return [np.concatenate(column) for column in zip(*parts)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, asked in _meetings(batches, "chunk"):
            matrix, label = shape.matrix([row["vector"] for row in asked]), np.array([row["label"] for row in asked])
            akey, own = np.array([row["akey"] for row in asked]), np.array([row["anchor_id"] for row in asked])
            lo, hi = _windows(asked)
            wanted = [set(row["blocks"]) for row in asked]
            parts = []
            for block in held:
                places = np.flatnonzero(np.fromiter((block["block"] in w for w in wanted), bool, len(wanted)))
                if len(places):
                    found = of_block(block, matrix[places], label[places], own[places], lo[places], hi[places])
                    parts.append([places[found[0]], *found[1:]])
            if parts:
                place, window, vec_id, score = [np.concatenate(column) for column in zip(*parts)]
                kept = first_of(place * lo.shape[1] + window, score, vec_id, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(akey[place[kept]]), pa.array(own[place[kept]]), pa.array(window[kept].astype(np.int32)), pa.array(vec_id[kept]), pa.array(score[kept])], names)

    candidates = blocks.select("chunk", "block", "ids", "labels", "vectors")
    found = _streamed(candidates, sent, "chunk").mapInArrow(rows, "akey bigint, anchor_id bigint, window int, vec_id bigint, score bigint")
    ranked = F.row_number().over(Window.partitionBy("akey", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor_step: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows (vec_id, label, v).

    Anchors are rows whose vec_id the step divides. A negative's score is at most its positive's and at least 80 hundredths of it.
    """
    shape = Shape(rows)
    blocks = index(rows, shape)
    anchors = anchors_of(blocks, shape, anchor_step, positives)
    found = search(blocks, anchors, shape, True, positives)
    chosen = stored(found.select("akey", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # ceil(80 p / 100) without leaving 64 bits; the window of a negative score is empty.
    window = F.struct((F.col("positive_score") - F.expr("positive_score div 5")).alias("lo"), F.col("positive_score").alias("hi"))
    none = F.struct(F.lit(MOST).alias("lo"), F.lit(LEAST).alias("hi"))
    listed = chosen.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct(
        "window", F.when(F.col("positive_score") >= 0, window).otherwise(none).alias("w")))).alias("ws"))
    narrowed = anchors.drop("windows").join(listed, "akey").select("akey", "anchor_id", "label", "vector", F.col("ws.w").alias("windows"))
    return search(blocks, narrowed, shape, False, negatives).join(chosen, ["akey", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
