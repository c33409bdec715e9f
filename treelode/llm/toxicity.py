"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration; everything learned from labels.

Learning uses labels of documents whose crc32(doc_id as text) mod 4 is not 2, at most SAMPLE of them, chosen by a hash: a
bounded sample, so the labels that join the documents are few and the trees are grown on one machine. A text counts once
however often it is copied. A second hash deals the sample into three parts. The first gives the lexicon: words and
beginnings of words (4 and 5 letters) that are surely more frequent in toxic texts, at most LEXICON of them. The second
grows the trees, the third calibrates them. Every document is then scored as a whole, from its text alone.

Features: density, mean and greatest weight of lexicon words, the same for beginnings, lexicon words within NEAR words of a
second person, shares of words in capitals, of words with repeated marks, of words with signs or digits between letters
(which are looked up in the lexicon as the letters they stand for), and the logarithm of the length.

Defined results: null and empty texts have all features 0 and the score that goes with that; repeated rows each have a row;
a document with several labels is toxic if one of them says so; labels that are null or have no document are not learned
from; without labels of both kinds in each part every score is the share of toxic labels (0 if there is none); other
columns than doc_id and text are not looked at.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelode.llm.common import map_whole_rows, slices, stored, texts_of

SAMPLE, LEXICON, FOLDS, HELD_OUT, THRESHOLD = 24_000, 400, 4, 2, 0.3
NEAR = 5
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.15, 64, 5
WORDS_KEPT = 400_000
# Second persons of the languages in use.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
                          "tú ti tus usted ustedes vosotros os".split())
# Letters that signs and digits stand for.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
EDGES = "\"'`.,;:!?()[]{}<>#%&*$|+=~^/\\"
HIDDEN = re.compile(r"[^\W\d_][0-9@$!*._-]+[^\W\d_]")
REPEATED = re.compile(r"[!?]{2,}|[%#&$*]{2,}")


def crc_mod(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def is_held_out(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def keys_of(core: str) -> list[str]:
    """Lexicon keys of a word: the word, and its first 4 and 5 letters."""
    return ["=" + core] + [core[:n] for n in (4, 5) if len(core) > n]


# -- features ---------------------------------------------------------------------------------------------------------

FEATURES = 11


class Words(dict):
    """Numbers of words, and what each says by itself: weight, weight of its beginning, and four flags."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.rows = lexicon, []

    def __missing__(self, word: str) -> int:
        core = word.strip(EDGES).lower()
        keys = keys_of(core)
        hidden = bool(HIDDEN.search(core))
        if hidden:
            keys += keys_of(core.translate(STANDS_FOR))
        get = self.lexicon.get
        weights = [max((get(k, 0.0) for k in keys if (k[0] == "=") == whole), default=0.0) for whole in (True, False)]
        self.rows.append((*weights, core in SECOND_PERSON, len(core) > 1 and word.isupper(), bool(REPEATED.search(word)), hidden))
        self[word] = number = len(self)
        return number


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.words, self.facts = Words(lexicon), np.empty((0, 6))

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.words) > WORDS_KEPT:
            self.words, self.facts = Words(self.lexicon), np.empty((0, 6))
        found = [text.split() for text in texts]
        numbers = [np.fromiter(map(self.words.__getitem__, row), np.int64, len(row)) for row in found]
        if self.words.rows:
            self.facts = np.concatenate((self.facts, np.array(self.words.rows, np.float64)))
            self.words.rows.clear()
        return np.array([self._of_text(self.facts[row]) for row in numbers]).reshape(-1, FEATURES)

    @staticmethod
    def _of_text(facts: np.ndarray) -> np.ndarray:
        n = len(facts)
        if not n:
            return np.zeros(FEATURES)
        weight, start = facts[:, 0], facts[:, 1]
        hits = np.flatnonzero((weight > 0) | (start > 0))
        persons = np.flatnonzero(facts[:, 2])
        beside = 0
        if len(hits) and len(persons):
            place = np.searchsorted(persons, hits)
            before, after = persons[np.maximum(place - 1, 0)], persons[np.minimum(place, len(persons) - 1)]
            beside = (np.minimum(abs(hits - before), abs(after - hits)) <= NEAR).sum()
        return np.array([np.log1p(n), (weight > 0).mean(), weight.mean(), weight.max(), (start > 0).mean(), start.mean(), start.max(),
                         beside / n, *facts[:, 3:].mean(axis=0)])


# -- trees ------------------------------------------------------------------------------------------------------------


def grow(bins: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int) -> tuple:
    """A tree over binned features: (feature, bin, left, right), or a value."""
    total, weight = slope.sum(), curve.sum()
    best = (1e-6, None, None)
    if depth and len(bins) >= 2 * LEAF:
        for feature in range(bins.shape[1]):
            column = bins[:, feature]
            g, h = np.bincount(column, slope, BINS).cumsum(), np.bincount(column, curve, BINS).cumsum()
            n = np.bincount(column, minlength=BINS).cumsum()
            gain = g ** 2 / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total ** 2 / (weight + 1)
            gain[(n < LEAF) | (len(bins) - n < LEAF)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), feature, int(gain.argmax()))
    if best[1] is None:
        return (RATE * total / (weight + 1),)
    left = bins[:, best[1]] <= best[2]
    return (best[1], best[2], grow(bins[left], slope[left], curve[left], depth - 1), grow(bins[~left], slope[~left], curve[~left], depth - 1))


def evaluate(tree: tuple, bins: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(bins), tree[0])
    return np.where(bins[:, tree[0]] <= tree[1], evaluate(tree[2], bins), evaluate(tree[3], bins))


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, share of label 1) of the best non-decreasing fit: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for x in np.unique(score):
        at = score == x
        blocks.append([x * at.sum(), label[at].sum(), at.sum()])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    mass = np.array(blocks)
    return mass[:, 0] / mass[:, 2], mass[:, 1] / mass[:, 2]


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], share: float):
        self.lexicon, self.share, self.trees = lexicon, share, []
        self.cuts: list[np.ndarray] = []
        self.knots = (np.zeros(1), np.full(1, share))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, x[:, n]) for n, cut in enumerate(self.cuts)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return sum((evaluate(tree, bins) for tree in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> Model:
        self.cuts = [np.unique(np.quantile(x[:, n], np.linspace(0, 1, BINS)[1:-1])) for n in range(x.shape[1])]
        bins, total = self.binned(x), np.zeros(len(x))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            self.trees.append(grow(bins, y - p, p * (1 - p), DEPTH))
            total += evaluate(self.trees[-1], bins)
        self.knots = isotonic(self.raw(held_x), held_y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between knots the line, so that higher raw scores stay higher."""
        return np.interp(self.raw(x), *self.knots) if self.trees else np.full(len(x), self.share)


# -- learning and scoring ---------------------------------------------------------------------------------------------


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, part) of the bounded sample; parts 0 and 1 of 4 for the lexicon, 2 for the trees, 3 to calibrate."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(FOLDS) != HELD_OUT))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    once = texts.groupBy(F.xxhash64("text").alias("digest")).agg(F.max(F.struct("toxic", "text")).alias("r"))
    return once.select("r.text", (F.col("r.toxic") > 0).cast("int").alias("toxic"), F.pmod("digest", F.lit(4)).alias("part"))


def lexicon_of(sample: DataFrame) -> dict[str, float]:
    """Keys that are more frequent in toxic texts beyond doubt, with the lower bound of their log odds as weight."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, toxic = [], []
            for text, label in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                cores = {word.strip(EDGES).lower() for word in set(text.split())} - {""}
                found = {key for core in cores for key in keys_of(core)}
                keys += found
                toxic += [label] * len(found)
            yield pa.RecordBatch.from_pydict({"key": keys, "toxic": pa.array(toxic, pa.int64())}, pa.schema({"key": pa.string(), "toxic": pa.int64()}))

    counted = sample.select("text", "toxic").mapInArrow(rows, "key string, toxic bigint").groupBy("key").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    sizes = sample.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).first()
    if not sizes.toxic or not sizes.clean:
        return {}
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (sizes.toxic + 1 - a)) - F.log(b / (sizes.clean + 1 - b)) - 2 * F.sqrt(1 / a + 1 / b)
    best = counted.where("a >= 3").withColumn("weight", odds).where("weight > 1").orderBy(F.desc("weight"), "key").limit(LEXICON)
    return {row.key: row.weight for row in best.collect()}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Runs jobs at once: the sample into the shared folder, the lexicon, and the features of the other two parts."""
    sample = stored(sample_of(docs, labels), "toxicity-sample")
    share = sample.agg(F.avg("toxic")).first()[0] or 0.0
    lexicon = lexicon_of(sample.where("part < 2"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(features.of(texts_of(batch))), pa.list_(pa.float64())),
                                              batch.column("toxic"), batch.column("part")], ["x", "toxic", "part"])

    found = sample.where("part >= 2").select("text", "toxic", "part").mapInArrow(rows, "x array<double>, toxic int, part bigint").collect()
    parts = []
    for part in (2, 3):
        chosen = sorted((row.x, row.toxic) for row in found if row.part == part)
        parts += [np.array([x for x, _ in chosen]).reshape(-1, FEATURES), np.array([y for _, y in chosen], np.float64)]
    model = Model(lexicon, share)
    return model.fit(*parts) if all(len(set(y.tolist())) == 2 for y in parts[1::2]) else model


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = learn(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.lexicon)
        for batch in slices(batches):
            found = model.score(features.of(texts_of(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(is_held_out, batch.column("doc_id").to_pylist()), pa.bool_()),
                 pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], schema.names)

    named = [("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(*x) for x in named)])
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted to be toxic, with all their columns."""
    model = learn(docs, labels)

    def start():
        features = Features(model.lexicon)
        return lambda batch, place: batch.filter(pa.array(model.score(features.of(texts_of(batch, place))) < THRESHOLD))

    return map_whole_rows(docs, start)
