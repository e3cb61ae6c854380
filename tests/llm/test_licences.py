"""The licence classifier on sentences that are no templates, and its chances against plain sums."""

from __future__ import annotations

import math

import numpy as np

from tidemark.llm import licences

#: Statements that are not among the templates, with their family.
UNSEEN = (
    ("This software is released under the MIT License, see the file LICENSE.", "mit"),
    ("The code of this chapter is licensed under the terms of the MIT license and may be reused.", "mit"),
    ("All examples are licensed under the Apache License, Version 2.0, unless noted.", "apache-2.0"),
    ("Our parser is licensed under the GNU General Public License, version 3, or later.", "gpl-3.0"),
    ("The engine is released under the GPL v2 license since last year.", "gpl-2.0"),
    ("The figures are licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Copyright 2023 by the editors. All rights reserved.", "all-rights-reserved"),
    ("The text was dedicated to the public domain under CC0 1.0 Universal by its author.", "public-domain"),
    ("The library is licensed under the GNU Lesser General Public License, version 2.1 only.", "lgpl"),
    ("The source code form is subject to the terms of the Mozilla Public License, v. 2.0, as always.", "mpl-2.0"),
)
PLAIN = (
    "The river is subject to the terms of the old contract between both towns.",
    "You may use this room for any purpose, with or without a key.",
    "The public library is open to any person with a card.",
    "The general of the army was granted permission to leave.",
)


def test_unseen_statements():
    model = licences.train([], [])
    named = [[f for f, *_ in model.statements(t)] for t, _ in UNSEEN]
    assert np.mean([want in got for got, (_, want) in zip(named, UNSEEN, strict=True)]) >= 0.9
    assert all(set(got) <= {want} for got, (_, want) in zip(named, UNSEEN, strict=True))
    assert not any(model.statements(t) for t in PLAIN)


def test_chances_by_plain_sums():
    model = licences.train([], [])
    for text, _ in UNSEEN:
        found = licences.words(text)
        own = {g for n in (1, 2, 3) for g in licences.grams(found, n)} & model.numbers.keys()
        out = [sum(model.weights[model.numbers[g], c] for g in own) / math.sqrt(len(own)) + model.weights[-1, c] for c in range(len(model.classes))]
        top = max(out)
        raw = [math.exp(x - top) for x in out]
        licence = 1 / (1 + math.exp(-(model.line[0] * math.log(sum(raw[1:]) / raw[0]) + model.line[1])))
        want = [1 - licence] + [x / sum(raw[1:]) * licence for x in raw[1:]]
        assert np.allclose(model.chances(found), want, rtol=1e-6, atol=1e-9)


def test_the_needed_chance_keeps_ordinary_paragraphs_out():
    rng = np.random.default_rng(1)
    fill = [w for t in (*licences.ORDINARY, *PLAIN) for w in licences.words(t)]
    ordinary = [" ".join(rng.choice(fill, 12)) for _ in range(400)]
    model = licences.train(ordinary[::2], ordinary[1::2])
    unseen = [*licences.ORDINARY, *ordinary[1::2]]
    assert sum(1 - model.chances(licences.words(p))[0] >= model.needed for p in unseen) <= len(unseen) / 1000


def test_paragraphs_behind_the_start_of_a_text_are_learned_from(spark):
    late = "the council will license the late restaurant of the harbour"
    docs = spark.createDataFrame([("x " * 3000 + "\n" + late,)], "text string")
    model = licences.fit(docs)
    assert 1 - model.chances(licences.words(late))[0] < model.needed
