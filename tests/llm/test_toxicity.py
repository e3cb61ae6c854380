"""The toxicity model against a plain recomputation of its probabilities on a small corpus."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import toxicity as T


def plain(texts, discount):
    """Kneser-Ney chances from sets of triples: chance(class, before, word)."""
    triples = [set(), set()]
    for label, text in texts:
        found = ["", "", *T.words(text)]
        triples[label].update(zip(found, found[1:], found[2:], strict=False))
    pairs = [defaultdict(set), defaultdict(set)]
    for c in (0, 1):
        for a, b, w in triples[c]:
            pairs[c][b, w].add(a)
    singles = [defaultdict(set), defaultdict(set)]
    shared = defaultdict(set)
    for c in (0, 1):
        for b, w in pairs[c]:
            singles[c][w].add(b)
            shared[w].add(b)
    every = sum(map(len, shared.values()))

    def chance(c, before, word):
        base = max(len(shared.get(word, ())) - T.SHARED, 0) / every + T.SHARED * len(shared) / every / (len(shared) + 1)
        total = sum(map(len, singles[c].values()))
        spent = sum(min(len(s), discount) for s in singles[c].values())
        one = max(len(singles[c].get(word, ())) - discount, 0) / total + spent / total * base
        own = {w: len(s) for (b, w), s in pairs[c].items() if b == before}
        if not own:
            return one
        kept = {w: max(n - T.PAIRS * discount, 0) / sum(own.values()) for w, n in own.items()}
        return kept.get(word, 0) + (1 - sum(kept.values())) * one

    return chance


def corpus():
    rng = np.random.default_rng(4)
    ordinary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(80):
        found = list(rng.choice(ordinary, 60))
        if i % 2:
            for at in range(5, 55, 10):
                found[at : at + 2] = ["go", "away"] if at % 20 else ["vile", found[at + 1]]
        rows.append((i % 2, " ".join(found)))
    return rows


def test_chances_are_those_of_a_plain_model(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i % T.PARTS, label, text) for i, (label, text) in enumerate(texts)], "own int, toxic int, text string")
    for discount in (1, 2):
        counts = T.count(rows, discount)
        for part, chosen in ((T.PARTS, texts), (0, [t for i, t in enumerate(texts) if i % T.PARTS])):
            chance, model = plain(chosen, discount), T.Model(counts[part])
            assert len(model.keys) > 0 or discount > 1
            for _, text in texts[:6]:
                found = T.words(text)
                got = model.chances(found)
                for at, (before, word) in enumerate(zip(["", *found], found, strict=False)):
                    if word in model.ids:
                        for c in (0, 1):
                            assert math.isclose(got[c, at], chance(c, before, word), rel_tol=1e-6), (before, word)


def test_evidence_is_the_best_mean_of_short_expressions(spark, monkeypatch):
    rows = spark.createDataFrame([(i % T.PARTS, label, text) for i, (label, text) in enumerate(corpus())], "own int, toxic int, text string")
    model = T.Model(T.count(rows, 1)[T.PARTS])
    found = T.words(corpus()[1][1]) * 3
    chance = np.log(model.chances(found))
    ratio = chance[1] - chance[0]
    best = max(ratio[i : i + n].mean() for n in range(1, T.SPAN + 1) for i in range(len(ratio) - n + 1))
    assert model.evidence(found) == pytest.approx((ratio.mean(), best))
    monkeypatch.setattr(T, "BLOCK", 7)
    assert model.evidence(found) == pytest.approx((ratio.mean(), best))
    assert model.evidence([]) == (0.0, 0.0)


def test_expressions_of_ordinary_words_are_seen(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, label) for i, (label, _) in enumerate(texts)], "doc_id long, toxic int")
    truth = dict(enumerate(label for label, _ in texts))
    scores = {r["doc_id"]: r["predicted"] for r in T.op9_toxicity(docs, labels).collect()}
    assert np.mean([scores[i] == truth[i] for i in truth]) > 0.95
