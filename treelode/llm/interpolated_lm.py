"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | v) = a(b) c(vw) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1), where b is the bucket of the context's count c(v) by powers
of two. The weights of each bucket come from expectation-maximisation on deleted counts: every token of every training text is
left out of the counts that the estimates for it are made of (c(vw) - 1, c(v) - 1, c(w) - 1, N - 1). Tasks count those tokens by
bucket and by the ratios of their estimates to the uniform one, in steps of 1 / STEPS of a power of two, with the mean of each step; the rounds
run on that table, whose size does not depend on the input. Copies of a text count as they do in the estimates.

Tokens and pairs of tokens are 64-bit hashes. Texts travel in compressed slices of about two megabytes, dealt to blocks in turn, so that
equal rows do not meet in one block. Blocks are as many as BLOCK_BYTES of text ask for, the session's shuffle partitions at
least, and a block is one group of the job:
  1. each block sends every range of hashes one message: the sorted distinct hashes it has there, with its training counts;
  2. each range adds up the counts by hash and answers each block with the totals, in the order of its message;
  3. each block gives every text with the totals of its tokens and pairs, which are kept in the shared folder. From them
     the weights are learned and then the texts scored.
Messages are arrays, so a hash costs about six bytes in the shuffle; texts are shuffled once and read by steps 1 and 3. A
frequent token or pair is one entry per block and range. Ranges are as many as blocks, so a task holds a block of texts or a range of
hashes, neither of which grows with the input; messages grow with the square of the blocks, a few million at 30 GB.

Defined results: null and empty texts have only the end token; repeated rows each count and each have a row; rows without doc_id
are training texts; without any training text N and V are 0 and all probability is uniform; an empty table gives an empty
table; other columns than doc_id and text are not looked at.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from treelode.llm.common import slices, stored, texts_of, whole_text

FOLDS, HELD_OUT = 7, 2
ROUNDS, STEPS, CODES, UNIT = 40, 8, 2048, 1 << 20
BUCKETS = 40
BLOCK_BYTES = 12 << 20
WORDS_KEPT = 300_000
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b"\n", b"\t"))  # no word is white space
MESSAGE = "range int, block int, keys binary, counts binary"
ANSWER = "block int, range int, counts binary"


class Hashes(dict):
    """Numbers of words; their hashes by number."""

    def __init__(self):
        self.fresh: list[int] = []
        self.table = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(xxhash.xxh64_intdigest(word))
        self[word] = number = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self.table = np.concatenate((self.table, np.array(self.fresh, np.uint64)))
            self.fresh.clear()
        return self.table[numbers]


_hashes = Hashes()


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, one after the other, and how many each has."""
    global _hashes
    if len(_hashes) > WORDS_KEPT:
        _hashes = Hashes()
    words: list[bytes] = []
    sizes = []
    for text in texts:
        found = text.encode().lower().split()
        words += found
        words.append(b"\n")
        sizes.append(len(found) + 1)
    return _hashes.of(words), np.array(sizes, np.int64)


def contexts_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; BEGIN before the first of a text."""
    before = np.roll(tokens, 1)
    before[np.cumsum(sizes) - sizes] = BEGIN
    return before


def pairs_of(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + tokens
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ mixed >> np.uint64(32)


def is_training(doc_id: object) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


# -- messages ---------------------------------------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the zeros of small values compress away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpacked(content: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(content, np.uint8).reshape(width, len(content) // width).T).view(kind).ravel()


def sorted_packed(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def sorted_unpacked(content: bytes) -> np.ndarray:
    return np.cumsum(unpacked(content, np.uint64), dtype=np.uint64)


def distinct_of(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys, by sorting."""
    keys = np.sort(keys)
    return keys[np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))]


def range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    bounds = np.array([(n << 64) // ranges for n in range(1, ranges)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def dealt(texts: DataFrame, blocks: int) -> DataFrame:
    """(block, rows): slices of (doc_id, text) as compressed Arrow streams, dealt in turn by every task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * 7919  # tasks begin at different blocks
        for batch in slices(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([number % blocks], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])
            number += 1

    return texts.select("doc_id", "text").mapInArrow(rows, "block int, rows binary")


class Block:
    """Tokens of a block of texts, and its sorted distinct token and pair hashes with their training counts."""

    def __init__(self, table: pa.Table):
        batches = [batch for content in table["rows"].to_pylist() for batch in pa.ipc.open_stream(content)]
        parts = [(tokens_of(texts_of(batch)), batch.column("doc_id").to_pylist()) for batch in batches]
        self.doc_ids = [doc_id for _, ids in parts for doc_id in ids]
        self.sizes = np.concatenate([sizes for (_, sizes), _ in parts])
        self.tokens = np.concatenate([tokens for (tokens, _), _ in parts])
        self.before = contexts_of(self.tokens, self.sizes)
        self.pairs = pairs_of(self.before, self.tokens)
        self.training = np.array([is_training(doc_id) for doc_id in self.doc_ids], bool)
        learned = np.repeat(self.training, self.sizes)
        kept, n = np.unique(np.concatenate((self.tokens[learned], self.pairs[learned])), return_counts=True)
        self.keys = distinct_of(np.concatenate((kept, self.tokens[~learned], self.pairs[~learned])))
        self.counts = np.zeros(len(self.keys), np.uint64)
        self.counts[np.searchsorted(self.keys, kept)] = n

    def totals_of(self, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Totals of keys that occur in the block; looked up in order, which is faster."""
        order = np.argsort(keys)
        found = np.empty(len(keys), np.float64)
        found[order] = totals[np.searchsorted(self.keys, keys[order])]
        return found


def message_of(ranges: int):
    def rows(table: pa.Table) -> pa.Table:
        block = Block(table)
        cuts = range_cuts(block.keys, ranges)
        parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"range": pa.array(range(ranges), pa.int32()), "block": pa.array([table["block"][0].as_py()] * ranges, pa.int32()),
                         "keys": [sorted_packed(block.keys[part]) for part in parts], "counts": [packed(block.counts[part]) for part in parts]})

    return rows


def answers_of(table: pa.Table) -> pa.Table:
    keys = [sorted_unpacked(content) for content in table["keys"].to_pylist()]
    counts = [unpacked(content, np.uint64) for content in table["counts"].to_pylist()]
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
    totals = np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else every
    distinct = every[first]
    found = [packed(totals[np.searchsorted(distinct, part)]) for part in keys]
    return pa.table({"block": table["block"], "range": table["range"], "counts": found})


# -- weights ----------------------------------------------------------------------------------------------------------


def bucket_of(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def estimates(pair: np.ndarray, context: np.ndarray, token: np.ndarray, total: float, distinct: float) -> np.ndarray:
    """Bigram, unigram and uniform estimate of each token, from its counts."""
    return np.stack((pair / np.maximum(context, 1), token / max(total, 1), np.full(len(pair), 1 / (distinct + 1))), axis=1)


def mixture(pair: np.ndarray, context: np.ndarray, token: np.ndarray, total: float, distinct: float, weights: np.ndarray) -> np.ndarray:
    """Probability of each token, some at a time."""
    mixed = np.empty(len(pair))
    for first in range(0, len(pair), 1 << 18):
        part = slice(first, first + (1 << 18))
        parts = estimates(pair[part], context[part], token[part], total, distinct)
        mixed[part] = (parts * weights[bucket_of(context[part])]).sum(1)
    return mixed


def weights_of(parts: np.ndarray, buckets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Weights (bucket, estimate) of greatest likelihood by expectation-maximisation; buckets with few tokens lean on all.

    A row has so many tokens whose estimates are in proportion to its parts.
    """
    every = np.array([1.0, 1.0, 1.0]) / 3
    for _ in range(ROUNDS):
        share = parts * every
        every = (share * (tokens / share.sum(1))[:, None]).sum(0) / tokens.sum() if len(parts) else every
    weights = np.tile(every, (BUCKETS, 1))
    for _ in range(ROUNDS):
        share = parts * weights[buckets]
        share *= (tokens / share.sum(1))[:, None]
        mass = np.stack([np.bincount(buckets, share[:, n], BUCKETS) for n in range(3)], axis=1)
        weights = (mass + 10 * every) / (mass.sum(1, keepdims=True) + 10)
    weights[0] = np.array([0.0, *weights[0, 1:] / weights[0, 1:].sum()])  # nothing is known after an unseen context
    return weights


def codes_of(logs: np.ndarray, some: np.ndarray) -> np.ndarray:
    """0 for a ratio of zero, else its power of two in steps."""
    return np.where(some, np.clip(np.rint(logs * (STEPS / UNIT)).astype(np.int64) + CODES // 2, 1, CODES - 1), 0)


def learned(texts: DataFrame, total: float, distinct: float, documents: float) -> np.ndarray:
    """The weights, from all training tokens of counted()."""
    if not total:
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sums = np.empty(0, np.int64), np.empty((3, 0))
        for batch in slices(batches, "pair"):
            pair, context, token, _ = totals_in(batch, documents)
            for first in range(0, len(pair), 1 << 18):
                part = slice(first, first + (1 << 18))
                deleted = context[part] - 1
                parts = estimates(pair[part] - 1, deleted, token[part] - 1, total - 1, distinct).T
                some = parts[:2] > 0
                logs = np.rint(np.log2(np.where(some, parts[:2] / parts[2], 1)) * UNIT)
                codes = codes_of(logs, some)
                found, place = np.unique(np.concatenate((cells, (bucket_of(deleted) * CODES + codes[0]) * CODES + codes[1])), return_inverse=True)
                more = np.concatenate((sums, (np.ones(len(deleted)), *logs)), axis=1)
                cells, sums = found, np.stack([np.bincount(place, values, len(found)) for values in more])
        yield pa.RecordBatch.from_arrays([pa.array(cells), *map(pa.array, sums.astype(np.int64))], ["cell", "tokens", "bigram", "unigram"])

    partial = texts.where("not held_out").select("n_tokens", "pair", "token").mapInArrow(rows, "cell bigint, tokens bigint, bigram bigint, unigram bigint")
    found = sorted(map(tuple, partial.groupBy("cell").agg(F.sum("tokens"), F.sum("bigram"), F.sum("unigram")).collect()))
    cells, tokens, *logs = np.array(found, np.int64).T
    ratios = [np.where(code > 0, 2.0 ** (log / tokens / UNIT), 0) for code, log in zip((cells // CODES % CODES, cells % CODES), logs)]
    return weights_of(np.stack((*ratios, np.ones(len(cells))), axis=1), cells // CODES // CODES, tokens)


def tallies(texts: DataFrame, ranges: int) -> tuple[float, float, float, float]:
    """Training tokens N, distinct training tokens V, training texts, and the bytes of all texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, facts = [], np.zeros(3)
        for batch in slices(batches):
            tokens, sizes = tokens_of(texts_of(batch))
            training = np.array([is_training(doc_id) for doc_id in batch.column("doc_id").to_pylist()], bool)
            every = np.repeat(training, sizes)
            distinct.append(distinct_of(tokens[every]))
            facts += (every.sum(), training.sum(), pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
        found = distinct_of(np.concatenate((np.empty(0, np.uint64), *distinct)))
        cuts = range_cuts(found, ranges)
        out = [(n, sorted_packed(found[a:b]), facts.tolist() if not n else [0.0] * 3) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        yield pa.RecordBatch.from_pydict(dict(zip(("range", "keys", "facts"), map(list, zip(*out)))), pa.schema(
            {"range": pa.int32(), "keys": pa.binary(), "facts": pa.list_(pa.float64())}))

    def added(table: pa.Table) -> pa.Table:
        keys = distinct_of(np.concatenate([sorted_unpacked(content) for content in table["keys"].to_pylist()]))
        return pa.table({"facts": [[*np.sum(table["facts"].to_pylist(), axis=0), float(len(keys))]]})

    partial = texts.select("doc_id", "text").mapInArrow(rows, "range int, keys binary, facts array<double>")
    found = partial.groupBy("range").applyInArrow(added, "facts array<double>").collect()
    total, documents, size, distinct = np.sum([row.facts for row in found], axis=0).tolist() if found else (0.0, 0.0, 0.0, 0.0)
    return total, distinct, documents, size


def first_pass(texts: DataFrame, ranges: int) -> tuple[float, float, float, np.ndarray]:
    """Training tokens N, distinct training tokens V, training texts, and the learned weights."""
    total, distinct, documents, _ = tallies(texts, ranges)
    return total, distinct, documents, learned(counted(texts, ranges, total), total, distinct, documents)


# -- scores -----------------------------------------------------------------------------------------------------------


def counted(texts: DataFrame, ranges: int, total: float) -> DataFrame:
    """doc_id, held_out, and the training totals of all pairs and tokens of every row, in the shared folder."""
    blocks = dealt(texts, ranges)
    kind = np.uint32 if total < 1 << 32 else np.uint64
    id_type = to_arrow_type(texts.schema["doc_id"].dataType)

    def rows(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        given = sorted(zip(answers["range"].to_pylist(), answers["counts"].to_pylist()))
        totals = np.concatenate([unpacked(content, np.uint64) for _, content in given])
        ends = np.cumsum(block.sizes)[:-1]
        pair, token = (pa.array([packed(part) for part in np.split(block.totals_of(keys, totals).astype(kind), ends)], pa.binary())
                       for keys in (block.pairs, block.tokens))
        return pa.table([pa.array(block.doc_ids, id_type), pa.array(~block.training), pa.array(block.sizes), pair, token],
                        names=schema.names)

    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("pair", T.BinaryType()), T.StructField("token", T.BinaryType())])
    messages = blocks.groupBy("block").applyInArrow(message_of(ranges), MESSAGE)
    answers = messages.groupBy("range").applyInArrow(answers_of, ANSWER)
    frame = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rows, schema)
    return stored(frame, "lm-totals", "zstd")


def totals_in(batch: pa.RecordBatch, documents: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Totals of pairs, contexts and tokens of all rows, one after the other, and where each row starts."""
    sizes = batch.column("n_tokens").to_numpy()
    pair, token = (np.concatenate([unpacked(content, np.uint32 if len(content) == 4 * size else np.uint64) for content, size in zip(
        batch.column(name).to_pylist(), sizes)]).astype(np.float64) for name in ("pair", "token"))
    starts = np.cumsum(sizes) - sizes
    context = np.roll(token, 1)
    context[starts] = documents
    return pair, context, token, starts


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. Learning runs jobs at once."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", whole_text().alias("text"))
    total, distinct, documents, size = tallies(texts, parts)
    known = counted(texts, max(parts, math.ceil(size / BLOCK_BYTES)), total)
    weights = learned(known, total, distinct, documents)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "pair"):
            pair, context, token, starts = totals_in(batch, documents)
            mixed = mixture(pair, context, token, total, distinct, weights)
            sums = [np.add.reduceat(values, starts) for values in (np.log10(token + 1), np.log10(mixed), (token > 0).astype(np.int64))]
            base = sums[0] - batch.column("n_tokens").to_numpy() * np.log10(total + distinct + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums[2]), pa.array(np.full(len(starts), int(total))), pa.array(base),
                                              pa.array(sums[1])], schema.names)

    named = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()),
             ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(*x) for x in named)])
    return known.mapInArrow(scored, schema)
