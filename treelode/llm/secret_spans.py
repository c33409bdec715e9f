"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags words (runs without ASCII white space) as beginning a secret, inside one or outside. Features are bits of a
word's shape, of the two words before and the one after it, and of the file. It learns by gradient ascent on its
likelihood from windows around words with a trigger (a digit, one of =:_@, or a secret's usual name), where the words in
pattern matches count as secrets; windows with other words that look random are not learned from, as nobody knows what
those are. Viterbi decodes. A word without trigger has no bit but the common one. Decoding
leaves out words only where that cannot change the best path: where "outside" leads by more than the two transitions at
the word could make up for. Texts without any trigger are one such case, decided once for the learned weights.

Windows come from documents chosen by a hash of doc_id, SAMPLE_DOCUMENTS on average, and at most WINDOWS of them with and
WINDOWS without a secret are learned from: a bounded sample, whatever the table's size. Every text is searched as a whole.

Defined results: null and empty texts have no spans; repeated rows each have a row; where no secret was seen in the sample,
or there is no row at all, the field adds nothing; other columns than doc_id and text are not looked at. Spans are in code
points, end exclusive; spans of the field that overlap a pattern match are left out.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelode.llm.common import map_whole_rows, slices, texts_of

SAMPLE_DOCUMENTS, WINDOWS, WINDOW_WORDS = 20_000, 3_000, 25
STEPS, RATE, RIDGE = 120, 0.1, 1e-3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
NAMES = ("passw", "secret", "token", "api")
TRIGGER = re.compile(r"[0-9=:_@]|passw|secret|token|api_?key|credential|auth", re.I | re.A)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("assign", "access", "hex", "field")
OUTSIDE, BEGIN, INSIDE = range(3)
TAGS = 3
NAMED = re.compile(r"passw|secret|token|api_?key|credential|auth", re.I | re.A)
KNOWN = re.compile(r"AKIA|gh[opsu]_|sk_|xox[abp]-|eyJ|AIza|-----BEGIN")
EDGES = "\"'`.,;!?()[]{}<>#%&*$|"
WORD_BITS, FILE_BITS = 24, 3
RANDOM, ADDRESS = 1 << 3 | 1 << 9 | 1 << 10, 1 << 14
"""Of the bits below: 16 or more characters, letters and digits, which change four times or more; an address."""
PLACES = (0, -1, -2, 1)
"""Words whose bits a tag sees: its own, the two before, the one after."""


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, in order; kind is a place in KINDS."""
    found = []
    lowered = text.lower()
    if any(name in lowered for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """What the field learns as secrets: assigned values, access keys and hexadecimal runs."""
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return values + [(start, end) for start, kind, end in pattern_spans(text) if kind]


def word_bits(word: str) -> int:
    """Shape of a word with a trigger."""
    core = word.strip(EDGES)
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "x" for c in core]
    letters, digits = kinds.count("l") + kinds.count("u"), kinds.count("d")
    turns = sum((a == "d") != (b == "d") for a, b in zip(kinds, kinds[1:]))
    entropy = -sum(n / len(core) * math.log2(n / len(core)) for n in Counter(core).values()) if core else 0.0
    stripped = word.rstrip(EDGES.replace(":", ""))
    facts = (
        True, *(len(core) >= n for n in (8, 12, 16, 24, 32)), digits > 0, "l" in kinds, "u" in kinds, digits > 0 and letters > 0,
        turns >= 4, turns >= 8, bool(core) and all(c in "0123456789abcdefABCDEF" for c in core),
        bool(re.fullmatch(r"[A-Za-z0-9+/_=-]+", core)), "@" in core or "://" in core or core.count(".") > 1,
        digits > 0 and letters == 0, bool(NAMED.search(word)), stripped.endswith(("=", ":")), bool(stripped) and not letters + digits,
        word[0] in "\"'`", bool(KNOWN.match(core)), bool(re.search(r"\w[=:]\w", core)), entropy >= 3.0, entropy >= 3.5)
    return sum(1 << i for i, fact in enumerate(facts) if fact)


def file_bits(text: str, words: int, triggered: int) -> int:
    lowered = text.lower()
    facts = (triggered > words * 0.02, any(name in lowered for name in NAMES), sum(map(text.count, "{};")) > len(text) * 0.01)
    return sum(1 << i for i, fact in enumerate(facts) if fact)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Starts, ends and bits of all words, which of them have a trigger, and the file's bits."""
    spans = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
    triggers = np.array([m.start() for m in TRIGGER.finditer(text)], np.int64)
    hit = np.unique(np.searchsorted(spans[:, 0], triggers, side="right") - 1)
    bits = np.ones(len(spans), np.int64)
    for n in hit.tolist():
        bits[n] = word_bits(text[spans[n, 0]:spans[n, 1]])
    return spans[:, 0], spans[:, 1], bits, hit, file_bits(text, len(spans), len(hit))


def tags_of(starts: np.ndarray, ends: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    tags = np.full(len(starts), OUTSIDE)
    for start, end in parts:
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(starts, end)
        tags[first:last] = INSIDE
        tags[first:first + 1] = BEGIN
    return tags


def spread_bits(bits: np.ndarray, size: int) -> np.ndarray:
    return (bits[..., None] >> np.arange(size) & 1).astype(np.float64)


def features_of(bits: np.ndarray, file: np.ndarray) -> np.ndarray:
    """A row of 0s and 1s per word: its own bits, its neighbours', the file's. `bits` has words along its last axis."""
    padded = np.concatenate((np.zeros((*bits.shape[:-1], 2), np.int64), bits, np.zeros((*bits.shape[:-1], 1), np.int64)), axis=-1)
    length = bits.shape[-1]
    near = [spread_bits(padded[..., 2 + place:2 + place + length], WORD_BITS) for place in PLACES]
    whole = np.broadcast_to(spread_bits(file, FILE_BITS)[..., None, :], (*bits.shape, FILE_BITS))
    return np.concatenate((*near, whole), axis=-1)


# -- learning ---------------------------------------------------------------------------------------------------------


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(bits: np.ndarray, sizes: np.ndarray, file: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, tag) and transitions (tag, tag) of greatest likelihood, by Adam. Windows are padded to one length."""
    x = features_of(bits, file)
    count, length, width = x.shape
    real = np.arange(length) < sizes[:, None]
    gold = np.eye(TAGS)[tags] * real[..., None]
    together = real[:, 1:] & real[:, :-1]
    gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1] * together[..., None], gold[:, 1:] * together[..., None])
    weights, moves = np.zeros((width, TAGS)), np.zeros((TAGS, TAGS))
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, STEPS + 1):
        score = x @ weights
        ahead, back = np.empty_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, length):
            going = log_sum(ahead[:, t - 1, :, None] + moves, 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], going, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            going = log_sum(moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(real[:, t + 1, None], going, 0.0)
        total = log_sum(ahead[:, -1], 1)
        share = np.exp(ahead + back - total[:, None, None]) * real[..., None]
        pairs = np.exp(ahead[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :] - total[:, None, None, None])
        pairs = (pairs * together[..., None, None]).sum((0, 1))
        slopes = (np.einsum("ntf,ntk->fk", x, gold - share) / count - RIDGE * weights, (gold_pairs - pairs) / count - RIDGE * moves)
        for n, (value, slope) in enumerate(zip((weights, moves), slopes)):
            first[n] = 0.9 * first[n] + 0.1 * slope
            second[n] = 0.999 * second[n] + 0.001 * slope ** 2
            value += RATE * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
    return weights, moves


def windows_in(text: str) -> Iterator[tuple[list[int], int, list[int]]]:
    """(bits, file bits, tags) of runs of at most WINDOW_WORDS words around words with a trigger."""
    if not TRIGGER.search(text):
        return
    starts, ends, bits, hit, file = words_of(text)
    tags = tags_of(starts, ends, secret_parts(text))
    done = 0
    for n in hit.tolist():
        if n >= done:
            begin, done = max(0, n - 4), n - 4 + WINDOW_WORDS
            window, known = bits[begin:done], tags[begin:done]
            if not ((window & RANDOM == RANDOM) & (window & ADDRESS == 0) & (known == OUTSIDE)).any():
                yield window.tolist(), file, known.tolist()


def learn(docs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights from the bounded sample, or None where it has no secret."""
    share = SAMPLE_DOCUMENTS / max(1, docs.count())
    chosen = F.pmod(F.xxhash64(F.lit("field"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [window for text in texts_of(batch) for window in windows_in(text)]
            if found:
                bits, file, tags = zip(*found)
                order = [int.from_bytes(hashlib.blake2b(repr(w).encode(), digest_size=7).digest()) for w in found]
                yield pa.RecordBatch.from_pydict(
                    {"bits": bits, "file": file, "tags": tags, "secret": [BEGIN in t for t in tags], "place": order},
                    pa.schema({"bits": pa.list_(pa.int64()), "file": pa.int64(), "tags": pa.list_(pa.int64()), "secret": pa.bool_(), "place": pa.int64()}))

    windows = docs.where(chosen).select("text").mapInArrow(
        rows, "bits array<bigint>, file bigint, tags array<bigint>, secret boolean, place bigint")
    # Equal windows have equal places: the ranking keeps the same ones whatever the order of the rows is.
    ranked = windows.groupBy("secret", "place").agg(F.first("bits").alias("bits"), F.first("file").alias("file"), F.first("tags").alias("tags"))
    kept = [row for secret in (True, False) for row in ranked.where(F.col("secret") == secret).orderBy("place").limit(WINDOWS).collect()]
    if not any(row.secret for row in kept):
        return None
    bits, tags = (np.zeros((len(kept), WINDOW_WORDS), np.int64) for _ in range(2))
    sizes = np.array([len(row.bits) for row in kept])
    for n, row in enumerate(kept):
        bits[n, :sizes[n]], tags[n, :sizes[n]] = row.bits, row.tags
    return fit(bits, sizes, np.array([row.file for row in kept]), tags)


# -- decoding ---------------------------------------------------------------------------------------------------------


def viterbi(score: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags of a run of words that stands between two words outside."""
    best, back = score[0] + moves[OUTSIDE], []
    for row in score[1:]:
        paths = best[:, None] + moves
        back.append(paths.argmax(0))
        best = paths.max(0) + row
    tag = int((best + moves[:, OUTSIDE]).argmax())
    path = [tag]
    for step in reversed(back):
        path.append(tag := int(step[tag]))
    return path[::-1]


class Field:
    """Learned weights, ready to decode."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        through = moves[:, :, None] + moves[None]  # from a over y to b; y other than outside gains this much at most
        self.lead = (through[:, 1:] - through[:, :1]).max()
        self.plain = all(self._sure(self.score(np.ones(7, np.int64), file)).all() for file in range(1 << FILE_BITS))

    def score(self, bits: np.ndarray, file: int) -> np.ndarray:
        return features_of(bits, np.array(file)) @ self.weights

    def _sure(self, score: np.ndarray) -> np.ndarray:
        return score[:, OUTSIDE] - score[:, 1:].max(1) > self.lead

    def spans(self, text: str) -> list[tuple[int, int]]:
        if self.plain and not TRIGGER.search(text):
            return []
        starts, ends, bits, _, file = words_of(text)
        if not len(starts):
            return []
        score = self.score(bits, file)
        tags = np.full(len(starts), OUTSIDE)
        open_ = np.flatnonzero(~self._sure(score))
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            if len(run):
                tags[run] = viterbi(score[run], self.moves)
        found, n = [], 0
        while n < len(tags):
            last = n
            if tags[n] != OUTSIDE:
                while last + 1 < len(tags) and tags[last + 1] == INSIDE:
                    last += 1
                piece = text[starts[n]:ends[last]]
                lead = len(piece) - len(piece.lstrip(EDGES))
                core = piece.strip(EDGES)
                if core:
                    found.append((int(starts[n]) + lead, int(starts[n]) + lead + len(core)))
            n = last + 1
        return found


def all_spans(text: str, field: Field | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of pattern matches and of what the field adds, in order."""
    base = pattern_spans(text)
    extra = field.spans(text) if field is not None else []
    added = [(a, 3, b) for a, b in extra if all(b <= start or end <= a for start, _, end in base)]
    return sorted(base + added)


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row. Learning runs jobs at once."""
    learned = learn(docs)
    field = None if learned is None else Field(*learned)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [all_spans(text, field) for text in texts_of(batch)]
            base = [[span for span in spans if span[1] < 3] for spans in found]
            counts = [pa.array([sum(span[1] == kind for span in spans) for spans in base], pa.int64()) for kind in range(3)]
            digests = pa.array([hashlib.sha256(as_text(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, digests, pa.array(map(as_text, found), pa.string())], schema.names)

    named = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(*x) for x in named)])
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def masked(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents, all columns and rows as they are, with every span of the text replaced by the mask."""
    learned = learn(docs)
    field = None if learned is None else Field(*learned)

    def cleaned(text: str | None) -> str | None:
        if not text:
            return text
        kept, place = [], 0
        for start, _, end in all_spans(text, field):
            if end > place:
                kept += [text[place:max(place, start)], mask] if start >= place else []
                place = end
        return "".join(kept) + text[place:]

    def change(batch: pa.RecordBatch, place: int) -> pa.RecordBatch:
        field_ = batch.schema.field(place)
        return batch.set_column(place, field_, pa.array([cleaned(text) for text in batch.column(place).to_pylist()], field_.type))

    return map_whole_rows(docs, lambda: change)
