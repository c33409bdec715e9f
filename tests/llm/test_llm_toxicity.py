"""Toxicity against a plain version: features word by word, trees by trying every split, the pooled fit by its max-min formula."""
import math
import re

import numpy as np
import pytest

from treelode.llm import toxicity

FOLDER = "/root/testdata/sf0.001"


def slow_features(text, lexicon):
    words = text.split()
    if not words:
        return [0.0] * toxicity.FEATURES
    rows = []
    for word in words:
        core = word.strip(toxicity.EDGES).lower()
        forms = [core]
        hidden = re.search(r"[^\W\d_][0-9@$!*._-]+[^\W\d_]", core) is not None
        if hidden:
            forms.append("".join(toxicity.STANDS_FOR.get(ord(c), c) or "" for c in core))
        whole = max(lexicon.get("=" + form, 0.0) for form in forms)
        begin = max([lexicon.get(form[:n], 0.0) for form in forms for n in (4, 5) if len(form) > n] + [0.0])
        rows.append((whole, begin, core in toxicity.SECOND_PERSON, len(core) > 1 and word.isupper(), bool(re.search(r"[!?]{2}|[%#&$*]{2}", word)), hidden))
    n = len(rows)
    persons = [i for i, row in enumerate(rows) if row[2]]
    beside = sum(1 for i, row in enumerate(rows) if (row[0] > 0 or row[1] > 0) and any(abs(i - p) <= toxicity.NEAR for p in persons))
    found = [math.log(1 + n)]
    for at in (0, 1):
        values = [row[at] for row in rows]
        found += [sum(v > 0 for v in values) / n, sum(values) / n, max(values)]
    return found + [beside / n] + [sum(row[at] for row in rows) / n for at in (3, 4, 5)]


def slow_tree(bins, slope, curve, depth):
    total, weight, best = sum(slope), sum(curve), (1e-6, None, None)
    if depth and len(bins) >= 2 * toxicity.LEAF:
        for feature in range(len(bins[0])):
            for cut in range(toxicity.BINS):
                left = [i for i, row in enumerate(bins) if row[feature] <= cut]
                if len(left) < toxicity.LEAF or len(bins) - len(left) < toxicity.LEAF:
                    continue
                g, h = sum(slope[i] for i in left), sum(curve[i] for i in left)
                gain = g * g / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total ** 2 / (weight + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, feature, cut)
    if best[1] is None:
        return (toxicity.RATE * total / (weight + 1),)
    sides = [[i for i, row in enumerate(bins) if (row[best[1]] <= best[2]) == left] for left in (True, False)]
    return (best[1], best[2], *(slow_tree([bins[i] for i in side], [slope[i] for i in side], [curve[i] for i in side], depth - 1) for side in sides))


def walk(tree, row):
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.learn(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))


@pytest.fixture(scope="module")
def texts(spark):
    odd = ["", "You", "you, STUPID!! id1ot @#$%", "s.t.u.p.i.d du", "A" * 5000, "x " * 3000 + "you"]
    return odd + [row.text for row in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]


def test_features_word_by_word(model, texts):
    lexicon = model.lexicon or {"=stupid": 2.0, "stup": 1.5, "idio": 1.2}
    found = toxicity.Features(lexicon).of(texts)
    assert np.allclose(found, [slow_features(text, lexicon) for text in texts], atol=1e-9)


def test_trees_by_every_split():
    seeded = np.random.default_rng(5)
    bins = seeded.integers(0, 8, (60, 4))
    slope, curve = seeded.normal(size=60), seeded.random(60)

    def same(a, b):
        if len(a) == 1 or len(b) == 1:
            return len(a) == len(b) and abs(a[0] - b[0]) < 1e-9
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])

    assert same(toxicity.grow(bins, slope, curve, 3), slow_tree(bins.tolist(), slope.tolist(), curve.tolist(), 3))


def test_pooled_fit_by_its_formula():
    seeded = np.random.default_rng(6)
    score = seeded.integers(0, 25, 200) / 5
    label = (seeded.random(200) < score / 6).astype(float)
    values = sorted(set(score.tolist()))
    mean = lambda a, b: label[(score >= a) & (score <= b)].mean()
    expected = {v: max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v) for v in values}
    knots, shares = toxicity.isotonic(score, label)
    # Each pooled block has one knot; its share is the fit of all scores in the block.
    assert sorted(set(np.round(shares, 9))) == sorted({round(v, 9) for v in expected.values()})
    assert (np.diff(knots) > 0).all() and (np.diff(shares) > 0).all()


def test_scores_of_the_query(spark, model, texts):
    rows = toxicity.scores(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")).orderBy("doc_id").collect()
    assert len(rows) == len(texts) - 6
    for row, text in zip(rows, texts[6:]):
        if not model.trees:
            assert abs(row.score - model.share) < 1e-12
            continue
        x = slow_features(text, model.lexicon)
        places = [sum(c < value - 1e-12 for c in cut) for cut, value in zip(model.cuts, x)]
        raw = sum(walk(tree, places) for tree in model.trees)
        knots, shares = model.knots
        n = sum(k <= raw for k in knots)
        expected = shares[0] if n == 0 else shares[-1] if n == len(knots) else shares[n - 1] + (shares[n] - shares[n - 1]) * (raw - knots[n - 1]) / (knots[n] - knots[n - 1])
        assert abs(row.score - expected) < 1e-6 and row.predicted == int(row.score >= 0.3)
