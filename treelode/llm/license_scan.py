"""License scans by ordered signature rules.

Texts are normalised to words with single spaces. An Aho-Corasick automaton finds the rules' keywords in one pass, and only rules whose
keyword occurs are matched, each at every word. Detections are intervals of words. One that lies within another
is suppressed where the other's rule has the higher priority, or the same priority and a longer interval, or the same interval
and an earlier rule; what is suppressed still suppresses. Phrases of the base stay and suppress nothing.

Defined results: null, empty and wordless texts have no words and no detections; a label counts once; the score is the
confidence of the surest detection that remains, 0 without any; repeated rows each have a row; an empty table gives
an empty table; texts are scanned whole; columns other than doc_id and text are not looked at.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import slices, texts_of
from treelode.llm.license_rules import BASE, KINDS, rule_lines

WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
DETECTIONS = "array<struct<rule: int, label: string, kind: string, first: bigint, last: bigint>>"


def normalised(text: str) -> str:
    """Words with single spaces; one character of the result for each byte of UTF-8."""
    return b" ".join(text.encode().translate(WORD_BYTES).split()).decode("latin-1")


def at_words(pattern: str) -> re.Pattern:
    """All places where the pattern matches from the begin of a word to the end of one."""
    latin = pattern.encode().decode("latin-1")
    return re.compile(rf"(?<![^ ])(?=((?:{latin})(?![^ ])))", re.ASCII)


class Rules:
    """Rules (kind, label, keyword, expression), base phrases, and what finds them."""

    def __init__(self, rules: list[tuple[str, str, str, str]], base: dict[str, str], kinds: dict[str, tuple[int, float]] = KINDS):
        self.given = rules, base, kinds
        self.rules, self.kinds = rules, kinds
        self.base = {normalised(phrase): label for phrase, label in base.items()}

    @cached_property
    def patterns(self) -> list[re.Pattern]:
        return [at_words(expression) for *_, expression in self.rules]

    @cached_property
    def base_patterns(self) -> list[tuple[re.Pattern, str]]:
        return [(re.compile(rf"(?<![^ ])(?=({re.escape(phrase)})(?![^ ]))"), label) for phrase, label in self.base.items()]

    @cached_property
    def keywords(self) -> ahocorasick.Automaton:
        """For every keyword the rules it opens, base phrases after the others."""
        opened: dict[str, list[int]] = {}
        for n, (_, _, keyword, _) in enumerate(self.rules):
            opened.setdefault(keyword.encode().decode("latin-1"), []).append(n)
        for n, phrase in enumerate(self.base):
            opened.setdefault(phrase, []).append(len(self.rules) + n)
        automaton = ahocorasick.Automaton()
        for keyword, numbers in opened.items():
            automaton.add_word(keyword, tuple(numbers))
        automaton.make_automaton()
        return automaton

    def detections(self, text: str) -> list[tuple[int, str, str, int, int]]:
        """(rule, label, kind, first word, last word) of what remains, by place; base phrases have rule -1 and kind `base`."""
        return self.place(normalised(text))

    def place(self, plain: str) -> list[tuple[int, str, str, int, int]]:
        opened = {n for _, numbers in self.keywords.iter(plain) for n in numbers}
        if not opened:
            return []
        spaces = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 32)

        def words(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
            """First and last word of spans of characters."""
            ends = np.searchsorted(spaces, np.array(found, np.int64).reshape(-1, 2) - [0, 1])
            return [tuple(pair) for pair in ends.tolist()]

        count = len(self.rules)
        found = [(first, last, n) for n in sorted(opened) if n < count
                 for first, last in words([m.span(1) for m in self.patterns[n].finditer(plain)])]
        rest = [(n, self.rules[n][1], self.rules[n][0], first, last) for first, last, n in self.unsuppressed(found)]
        for n in sorted(opened):
            if n >= count:
                pattern, label = self.base_patterns[n - count]
                rest += [(-1, label, "base", first, last) for first, last in words([m.span(1) for m in pattern.finditer(plain)])]
        return sorted(rest, key=lambda d: (d[3], d[4], d[0] if d[0] >= 0 else count, d[1]))

    def unsuppressed(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Those (first, last, rule) that no other of higher priority contains: one sweep in the order of priority.

        In that order, what may suppress comes first; the rest then only asks whether one before it begins no later and ends no sooner.
        """
        order = sorted(set(found), key=lambda d: (self.kinds[self.rules[d[2]][0]][0], d[0] - d[1], d[2]))
        firsts = sorted({first for first, *_ in order})
        place = {first: n for n, first in enumerate(firsts)}
        reach = [-1] * (len(firsts) + 1)  # greatest last word of spans that begin at or before a place, as a Fenwick tree
        kept = []
        for first, last, rule in order:
            at, n = -1, place[first] + 1
            while n:
                at = max(at, reach[n])
                n &= n - 1
            if at < last:
                kept.append((first, last, rule))
            n = place[first] + 1
            while n < len(reach):
                reach[n] = max(reach[n], last)
                n += n & -n
        return kept

    def confidence(self, kind: str) -> float:
        return self.kinds["family" if kind == "base" else kind][1]


def standard_rules() -> Rules:
    return Rules(rule_lines(), BASE)


def scanned(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, n_words, score, and detections: array of (rule, label, kind, first, last), words from 0, for every row."""
    plan = (rules or standard_rules()).given

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Rules(*plan)
        for batch in slices(batches):
            n_words, scores, lists = [], [], []
            for text in texts_of(batch):
                plain = normalised(text)
                found = own.place(plain)
                n_words.append(plain.count(" ") + 1 if plain else 0)
                scores.append(max((own.confidence(kind) for _, _, kind, _, _ in found), default=0.0))
                lists.append([dict(zip(("rule", "label", "kind", "first", "last"), d)) for d in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(scores, pa.float64()), pa.array(lists, detections)],
                                             ["doc_id", "n_words", "score", "detections"])

    detections = pa.list_(pa.struct([("rule", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, score double, detections {DETECTIONS}"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def licenses(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections for every row."""
    base = F.filter("detections", lambda d: d["kind"] == "base")
    firsts = F.transform(base, lambda d: d["first"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    return scanned(docs, rules).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("detections")).alias("labels"), "score", "detections")
