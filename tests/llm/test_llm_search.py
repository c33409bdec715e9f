"""License scans, hard negatives and lexical search against plain versions, on given tables and on odd rows."""
import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given as for_all, settings, strategies
from pyspark.sql import functions as F

from treelode.llm import hard_negatives, lexical_search, license_scan
from treelode.llm.license_rules import BASE, KINDS, rule_lines

FOLDER = "/root/testdata/sf0.001"
EXTRA = "rule int, detections string, term string, item long, rank int, copies int, block long, chunk long, akey long, windows string, v string, batch int"
LONG = "Released under the MIT License. " * 3000 + "y" * 100_000
LICENSED = [
    (1, None), (2, ""), (3, " .\n"), (4, LONG), (5, "Licensed under the Apache License, Version 2.0; see Apache License."), (5, "MIT-License"), (5, "MIT-License"),
    (None, "SPDX-License-Identifier: GPL-2.0-or-later / GNU General Public License"), (7, "submit license, mit licenseé, CC BY-NC 4.0 and cc by"), (8, "CC BY cc by, CC-BY/SA 3.0"),
    (9, "the MIT License, the mit license; GPL v3, GNU General Public License version 3 or (at your option) any later version"),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"),
    (11, "All rights reserved. Copyright (c) 2019 2020 Someone, 日本 license")]


def with_extra(frame):
    extra = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in EXTRA.split(", "))]
    return frame.select("*", *extra, F.lit("x").alias("a.b c"))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return with_extra(spark.createDataFrame(LICENSED, "doc_id long, text string"))


def rows_of(frame):
    return [(row[0], row.text or "") for row in frame.collect()]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


# -- licenses ---------------------------------------------------------------------------------------------------------


def slow_licenses(text):
    """Every rule at every word without keywords, every pair of detections compared."""
    words = words_of(text)
    places = {label: [n for n in range(len(words)) if words[n:n + len(phrase.split())] == phrase.split()] for phrase, label in BASE.items()}
    plain, starts = " ".join(words), {}
    at = 0
    for n, word in enumerate(words):
        starts[at] = n
        at += len(word) + 1
    found = []
    for number, (kind, label, _, expression) in enumerate(rule_lines()):
        pattern = re.compile(rf"(?:{expression})(?![^ ])")
        for start, n in starts.items():
            match = pattern.match(plain, start)
            if match:
                found.append((n, n + match.group().count(" "), number, label, kind))

    def hides(a, b):
        if a is b or a[0] > b[0] or a[1] < b[1]:
            return False
        return (KINDS[a[4]][0], a[0] - a[1], a[2]) < (KINDS[b[4]][0], b[0] - b[1], b[2])

    rest = [b for b in found if not any(hides(a, b) for a in found)]
    every = sorted(itertools.chain.from_iterable(places.values()))
    base = {label for label, at in places.items() if at}
    score = max([KINDS[d[4]][1] for d in rest] + [KINDS["family"][1] for _ in every], default=0.0)
    return (len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(base)),
            ",".join(sorted(base | {d[3] for d in rest})), score)


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_licenses_against_every_rule(request, name):
    frame = request.getfixturevalue(name)
    texts = {text: None for _, text in rows_of(frame)}
    expected = sorted(((i, *(texts[text] or texts.update({text: slow_licenses(text)}) or texts[text])) for i, text in rows_of(frame) if text != LONG), key=repr)
    found = license_scan.licenses(frame).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows = [tuple(row) for row in found.collect()]
    assert sorted((row for row in rows if row[1] != 15_001), key=repr) == expected
    if name == "odd":
        assert [row for row in rows if row[1] == 15_001] == [(4, 15_001, 3000, 3, 14_998, "mit", "mit", 0.95)]
        assert license_scan.licenses(frame.where("false")).count() == 0


def test_detections_say_where_and_why(spark):
    frame = spark.createDataFrame([(1, "x Licensed under the Apache License, Version 2.0")], "doc_id long, text string")
    found = license_scan.scanned(frame).first().detections
    assert [(d.label, d.kind, d.first, d.last) for d in found] == [("apache-2.0", "grant", 1, 8), ("apache", "base", 4, 5)]


def test_rules_are_well_formed():
    rules = rule_lines()
    assert len(rules) > 250 and all(kind in KINDS for kind, *_ in rules)
    scan = license_scan.standard_rules()
    assert len(scan.patterns) == len(rules)


@pytest.mark.parametrize("kind", list(KINDS))
def test_every_match_contains_its_keyword(kind):
    """Else the prefilter would hide it; matches are drawn from the expressions themselves."""
    for _, _, keyword, expression in (rule for rule in rule_lines() if rule[0] == kind):
        latin = re.sub(r"\[\^ \]", "[a-z]", expression).replace("(?! [0-9]| only| or later)", "")

        @settings(max_examples=6, database=None, deadline=None)
        @for_all(strategies.from_regex(f"(?:{latin})", fullmatch=True))
        def contained(text):
            assert keyword in text, (expression, text)

        contained()


def test_own_rules_and_priorities():
    rules = license_scan.Rules([("name", "long", "b", "a b c"), ("text", "inner", "b", "b"), ("hint", "all", "a", "a b c d")], {"c é": "base"}, KINDS)
    assert [(d[1], d[3], d[4]) for d in rules.detections("A b-C d, c é")] == [("long", 0, 2), ("all", 0, 3), ("inner", 1, 1), ("base", 4, 5)]


# -- hard negatives ---------------------------------------------------------------------------------------------------


def slow_negatives(rows, step=100, k=5):
    """rows: (vec_id, label, integers); anchors that repeat are one."""
    width = max((len(v) for *_, v in rows), default=0)
    matrix = np.array([list(v) + [0] * (width - len(v)) for *_, v in rows], object).reshape(len(rows), width)
    expected = []
    for anchor, label, v in sorted({(i, label, tuple(v)) for i, label, v in rows if i % step == 0}):
        scores = matrix @ np.array(list(v) + [0] * (width - len(v)), object)
        order = sorted((-int(s), i, l) for s, (i, l, _) in zip(scores, rows) if i != anchor)
        for s, i, _ in [r for r in order if r[2] == label][:k]:
            fits = [r for r in order if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            expected += [(anchor, i, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(fits)]
    return sorted(expected)


COLUMNS = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


@pytest.mark.parametrize("block_rows", [16, 512])
def test_hard_negatives_of_given_vectors(spark, monkeypatch, block_rows):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(hard_negatives, "PAGE_BLOCKS", 4)
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 3)
    rows = hard_negatives.whole_rows(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), F.col("label"))
    found = sorted(map(tuple, hard_negatives.mine(rows, 20).select(*COLUMNS).collect()))
    assert found == slow_negatives([tuple(row) for row in rows.collect()], 20) and len(found) > 300


def test_hard_negatives_of_odd_rows(spark):
    seeded = random.Random(4)
    close = [(n, n % 3, [1.0 + seeded.randrange(3) / 256, 0.5, seeded.choice([0.0, 0.25])]) for n in range(0, 240, 3)]
    odd = [(7, 1, None), (8, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (9, 1, [1.0, None]), (10, 1, [float("nan"), 1.0]), (11, 1, [float("inf"), 1.0]), (12, 2, []),
           (13, 2, [-1.0]), (100, 0, [-1.0, 0.0, 0.0]), (100, 0, [-1.0, 0.0, 0.0]), (200, 1, [1.0, 0.5]), (14, 0, [1.0, 0.5, 0.25, 3.0]), (14, 0, [1.0, 0.5, 0.25, 3.0]),
           (300, 9, [1.0]), (400, 1, [1.0, 0.5])]
    frame = with_extra(spark.createDataFrame(close + odd, "vec_id long, label int, embedding array<float>"))
    rows = hard_negatives.whole_rows(frame, F.col("label"))
    usable = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in close + odd if i is not None and l is not None and v is not None
              and all(x is not None and math.isfinite(x) for x in v)]
    assert sorted(map(tuple, hard_negatives.mine(rows).select(*COLUMNS).collect())) == slow_negatives(usable)
    assert hard_negatives.mine(rows.where("false")).count() == 0


def test_hard_negatives_of_large_components(spark):
    frame = spark.createDataFrame([(n, n % 2, [float(n * 1000 + 7), 40000.0 - n]) for n in range(0, 60, 4)] + [(100, 1, [3000.5, 39000.0])], "vec_id long, label int, embedding array<double>")
    rows = hard_negatives.whole_rows(frame, F.col("label"))
    assert sorted(map(tuple, hard_negatives.mine(rows).select(*COLUMNS).collect())) == slow_negatives([tuple(row) for row in rows.collect()])


@pytest.mark.parametrize("dimensions, bits", [(2, 1), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)), np.uint32)
    keys = hard_negatives.curve_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(keys)), key=keys.__getitem__)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_rule_out(spark):
    seeded = np.random.default_rng(1)
    anchors, members = seeded.integers(-300, 300, (20, 8)), seeded.integers(-300, 300, (15, 8))
    low, high = hard_negatives.bounds(anchors, members.min(0)[None], members.max(0)[None])
    scores = anchors @ members.T
    assert (scores >= low).all() and (scores <= high).all()
    full = hard_negatives.bounds(anchors << 40, members[:1] << 40, members[:1] << 40)
    assert (full[0] == hard_negatives.LEAST).all() and (full[1] == hard_negatives.MOST).all()
    frame = spark.createDataFrame([(n, 0, [float(n // 100 % 2 * 2 - 1) * (1 + n % 7 / 9), 0.0]) for n in range(400)], "vec_id long, label int, embedding array<double>")
    rows = hard_negatives.whole_rows(frame, F.col("label"))
    shape = hard_negatives.Shape(rows)
    blocks = hard_negatives.index(rows, shape)
    assert blocks.agg(F.sum("n")).first()[0] == 400
    anchors = hard_negatives.anchors_of(blocks, shape, 100, 5)
    sent = hard_negatives.choose(blocks, anchors, shape, True).select(F.size("blocks").alias("n")).agg(F.sum("n")).first()[0]
    assert sent < anchors.count() * blocks.count() or blocks.count() == 1


# -- lexical search ---------------------------------------------------------------------------------------------------


def slow_search(docs, items, k=20):
    counts = [(i, collections.Counter(words_of(text))) for i, text in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(size for *_, size in counts)
    df = collections.Counter(term for _, c, _ in counts for term in c)
    expected = []
    for item, text in items:
        scored = []
        for i, c, size in counts:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in words_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        expected += [(item, rank + 1, i, -score) for rank, (score, _, i) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return sorted(expected, key=repr)


def found_by(docs, items, **options):
    return sorted(map(tuple, lexical_search.ranked(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("batch_terms, cells", [(1 << 16, 1 << 24), (300, 1 << 11)])
def test_lexical_search_of_given_tables(spark, documents, monkeypatch, batch_terms, cells):
    monkeypatch.setattr(lexical_search, "SLICE_CELLS", cells)
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    expected = slow_search(rows_of(documents), rows_of(items))
    assert found_by(documents, items, batch_terms=batch_terms) == expected and len(expected) == 20 * items.count()


ITEMS = [(1, "the mit license"), (1, "the mit license"), (2, None), (3, ""), (4, "absent word"), (5, "THE the thé!"), (None, "license"), (6, "é"), (7, "yes " * 500 + "gpl x" * 300)]


def test_lexical_search_of_odd_rows(spark, odd):
    items = with_extra(spark.createDataFrame(ITEMS, "item_id long, text string"))
    for k in (1, 3, 20):
        assert found_by(odd, items, k=k) == slow_search(rows_of(odd), ITEMS_TEXT, k)


ITEMS_TEXT = [(i, text or "") for i, text in ITEMS]


def test_lexical_search_of_empty_tables(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found_by(odd.where("false"), items) == [] and found_by(odd, items.where("false")) == []
    assert found_by(odd.where("doc_id in (1, 2, 3)"), items) == []


def test_lexical_search_prefers_low_ids_among_equals(spark):
    docs = spark.createDataFrame([(n, "same words here") for n in range(90, 0, -1)] + [(None, "same words here")] * 2 + [(500, "other")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "same"), ("b", "words other")], "item_id string, text string")
    found = found_by(docs, items)
    assert [row[2] for row in sorted(found)[:20]] == list(range(1, 21))
    assert sorted(found)[20][2] == 500 and sorted(row[2] for row in sorted(found)[21:]) == list(range(1, 20))


def test_lexical_tree_prunes(spark):
    """Bounds hold at every node, and nodes below the weakest k-th score are left out."""
    seeded = np.random.default_rng(3)
    values = seeded.integers(0, 1000, (30, 200)) * (seeded.random((30, 200)) < 0.1)
    rows, terms = np.nonzero(values.T)
    tree = lexical_search.Documents(rows, terms, values.T[rows, terms], 200, 30)
    root = lexical_search.Items([{int(t): int(seeded.integers(1, 50)) for t in seeded.integers(0, 30, 6)} for _ in range(40)], 0)

    def leaves(node):
        return [leaf for part in node.parts for leaf in leaves(part)] if node.parts else [node]

    for leaf in leaves(root):
        scores = leaf.values @ values[leaf.terms]
        for level, nodes in enumerate(tree.levels):
            bound = lexical_search.inner(root.greatest[None], nodes[root.terms])[0]
            width = lexical_search.FAN ** level
            assert all(bound[n] >= scores[:, n * width:(n + 1) * width].max() for n in range(nodes.shape[1]))
    best = lexical_search.Best(40, 3)
    best.kth[:] = 1 << 60
    lexical_search.visit(root, tree, len(tree.levels) - 1, np.zeros(1, np.int64), best, np.arange(200), np.zeros(200, np.int64))
    assert not any(len(score) for score, *_ in best.kept)
