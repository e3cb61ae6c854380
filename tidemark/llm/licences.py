"""Licence statements in texts: a trained paragraph classifier, confirmed by templates.

A paragraph is described by its word 1- to 3-grams; a sparse multinomial
logistic regression gives the chance of each licence family and of the class `unknown`. The chance of
`unknown` is calibrated by a logistic function fitted on paragraphs of the corpus and variants of templates that
the regression was not fitted on; the chance that a licence needs is one that at most one in 1000 of these
paragraphs has. A prediction counts only if the paragraph and a template of that family share most of their
3-grams.

Paragraphs are lines; a line of over 2 * REACH characters is cut into windows of that length, each
starting REACH after the one before, so a statement of up to REACH characters is whole in one of them.
Paragraphs without a 3-gram of any template are not classified, as no template could confirm them.
A paragraph can state several families; a further one has to bring 3-grams that the others do not
explain. Adjacent paragraphs of one family are one statement.

Defined results: null and empty texts have no statement; rows are kept as often as they come, and all
their columns (an own `licences` column is replaced); without any text to calibrate on, the needed
chance is FLOOR; an empty table gives an empty result. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import draw, sigmoid, stored

#: Statements by family. Fixed values.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GPL v2 license.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Released under the GPL v3 license.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC license.",
        "SPDX-License-Identifier: ISC",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
#: Sentences with licence words that state no licence. Fixed values.
ORDINARY = (
    "She renewed her driving licence before the trip.",
    "The license plate of the car was muddy.",
    "He asked for permission to leave the table.",
    "The library has a permission slip for every pupil.",
    "The warranty covers parts and labour for two years.",
    "The park lies in the public domain of the city's memory.",
    "The court held that copyright subsists in the expression of ideas.",
    "The council will license the new restaurant next week.",
    "The licence fee was raised by the broadcaster.",
    "Redistribution of wealth was the topic of the debate.",
    "The band was licensed to play until midnight.",
    "The game license can be bought at the shop.",
)
UNKNOWN = "unknown"
REACH = 400
#: Share of 3-grams that a paragraph and a template have to share, of either of them.
SHARED = 0.6
#: The least chance that counts, whatever the calibration says.
FLOOR = 0.5
#: Documents whose paragraphs stand for the class unknown, at most, and how many of these paragraphs, by hash from
#: the whole texts: of those that share a 3-gram with a template, and of the others. Half of them calibrate.
MAX_TRAIN_DOCS = 1000
MAX_PARAGRAPHS = 2000
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(found: list[str], n: int) -> list[str]:
    return [" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]


def paragraphs(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) of all paragraphs, in order; only the windows of a long line overlap."""
    text, start = text or "", 0
    while start < len(text):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        while end - start > 2 * REACH:
            yield start, start + 2 * REACH
            start += REACH
        if end > start:
            yield start, end
        start = end + 1


class Model:
    """Classes (unknown first), n-gram numbers, weights (n-grams + 1, classes), slope and offset of the log odds
    that a paragraph states a licence, and the chance that counts."""

    def __init__(self, classes: list[str], numbers: dict[str, int], weights: np.ndarray, line: tuple[float, float] = (1.0, 0.0), needed: float = FLOOR):
        self.classes, self.numbers, self.weights, self.line, self.needed = classes, numbers, weights, line, needed
        self.templates = {family: [set(grams(words(t), 3)) or {" ".join(words(t))} for t in texts] for family, texts in TEMPLATES.items()}
        self.known = set().union(*(t for templates in self.templates.values() for t in templates))

    def raw(self, found: list[str]) -> np.ndarray:
        """Chances of the classes before the calibration."""
        at = _features(found, self.numbers)
        out = self.weights[at].sum(0) / max(len(at), 1) ** 0.5 + self.weights[-1]
        out = np.exp(out - out.max())
        return out / out.sum()

    def chances(self, found: list[str]) -> np.ndarray:
        """Calibrated: that of unknown, and what is left of it by the raw chances of the families."""
        raw = self.raw(found)
        licence = float(sigmoid(self.line[0] * _log_odds(raw) + self.line[1]))
        return np.concatenate([[1 - licence], raw[1:] / max(raw[1:].sum(), 1e-300) * licence])

    def confirmed(self, family: str, found: list[str]) -> bool:
        own = set(grams(found, 3))
        return any((common := len(own & t)) >= SHARED * len(t) or common >= max(2, SHARED * len(own)) for t in self.templates[family])

    def families(self, paragraph: str) -> list[tuple[str, float]]:
        """(family, chance) of the confirmed families, the likeliest first; none where a licence is too unlikely."""
        found = words(paragraph)
        own = self.known.intersection(grams(found, 3))
        if not own:
            return []
        chances = self.chances(found)
        if 1 - chances[0] < self.needed:
            return []
        listed, explained = [], set()
        for at in np.argsort(-chances[1:], kind="stable") + 1:
            family = self.classes[at]
            shared = own & set().union(*self.templates[family])
            if not shared <= explained and self.confirmed(family, found):
                listed.append((family, float(chances[at])))
                explained |= shared
        return listed

    def classify(self, paragraph: str) -> tuple[str, float]:
        return next(iter(self.families(paragraph)), (UNKNOWN, float(self.chances(words(paragraph)).max())))

    def statements(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(family, start, end, chance) by start; paragraphs of one family with only white space between are one."""
        listed: list[tuple[str, int, int, float]] = []
        last: dict[str, int] = {}
        for start, end in paragraphs(text):
            for family, chance in self.families(text[start:end]):
                at = last.get(family)
                if at is not None and not text[listed[at][2] : start].strip():
                    listed[at] = (family, listed[at][1], end, max(chance, listed[at][3]))
                else:
                    last[family] = len(listed)
                    listed.append((family, start, end, chance))
        return listed


def _log_odds(raw: np.ndarray) -> float:
    return float(np.log(max(raw[1:].sum(), 1e-12) / max(raw[0], 1e-12)))


def _features(found: list[str], numbers: dict[str, int]) -> np.ndarray:
    return np.array(sorted({numbers[g] for n in (1, 2, 3) for g in grams(found, n) if g in numbers}), np.int64)


def _variants(full: list[str], fill: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    """The words of a template with some left out, inside ordinary words."""
    out = []
    for _ in range(n):
        kept = [w for w in full if rng.random() > 0.06] if len(full) > 6 else full
        front, behind = (list(rng.choice(fill, int(rng.integers(0, 12)))) for _ in range(2))
        out.append([*front, *kept, *behind])
    return out


def train(ordinary: list[str], calibrate: list[str], epochs: int = 30, seed: int = 7) -> Model:
    """Fitted on the templates, alone, with words left out and inside paragraphs of ordinary words, against
    ordinary paragraphs. calibrate: ordinary paragraphs not fitted on; at most one in 1000 may pass."""
    rng = np.random.default_rng(seed)
    classes = [UNKNOWN, *sorted(TEMPLATES)]
    fill = [w for p in (ordinary or ORDINARY) for w in words(p)]
    rows: list[tuple[list[str], int]] = [(words(p), 0) for p in (*ORDINARY * 10, *ordinary)]
    unseen: list[tuple[list[str], int]] = [(words(p), 0) for p in (*ORDINARY, *calibrate)]
    for family, texts in sorted(TEMPLATES.items()):
        for t in texts:
            full, label = words(t), classes.index(family)
            rows += [(v, label) for v in [full, *_variants(full, fill, rng, 12)]]
            unseen += [(v, label) for v in _variants(full, fill, rng, 4)]
    numbers: dict[str, int] = {}
    for texts in (*TEMPLATES.values(), ORDINARY):
        for t in texts:
            for n in (1, 2, 3):
                for g in grams(words(t), n):
                    numbers.setdefault(g, len(numbers))
    inputs = [(_features(found, numbers), label) for found, label in rows]
    weights = np.zeros((len(numbers) + 1, len(classes)))
    seen = np.full_like(weights, 1e-3)
    for _ in range(epochs):
        for i in rng.permutation(len(inputs)):
            at, label = inputs[i]
            scale = 1 / max(len(at), 1) ** 0.5
            out = weights[at].sum(0) * scale + weights[-1]
            miss = np.exp(out - out.max())
            miss /= miss.sum()
            miss[label] -= 1
            for rows_at, step in ((at, miss * scale), (np.array([-1]), miss)):
                seen[rows_at] += step * step
                weights[rows_at] -= 0.3 * step / np.sqrt(seen[rows_at])
    model = Model(classes, numbers, weights)
    odds, states = np.array([_log_odds(model.raw(found)) for found, _ in unseen]), np.array([float(label > 0) for _, label in unseen])
    model.line = _calibrated(odds, states)
    passing = sigmoid(model.line[0] * odds[states == 0] + model.line[1])
    # strictly more than all but one in 1000
    model.needed = max(FLOOR, float(np.nextafter(np.sort(passing)[-1 - len(passing) // 1000], 2.0)))
    return model


def _calibrated(odds: np.ndarray, states: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic function of the log odds that fits the states best; both classes weigh the same."""
    a, w = np.column_stack([odds, np.ones(len(odds))]), np.array([1.0, 0.0])
    weight = np.where(states > 0, 0.5 / states.mean(), 0.5 / (1 - states.mean()))
    for _ in range(50):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2), a.T @ (weight * (states - p)) - 0.1 * (w - (1.0, 0.0)))
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return max(float(w[0]), 1e-3), float(w[1])


def _shared_grams(paragraph: str) -> int:
    """How many 3-grams of the paragraph the template that shares the most of them has."""
    own = set(grams(words(paragraph), 3))
    return max(len(own & t) for t in _template_grams()) if own else 0


@cache
def _template_grams() -> list[set[str]]:
    return [set(grams(words(t), 3)) for texts in TEMPLATES.values() for t in texts]


def fit(docs: DataFrame, bound: int = MAX_TRAIN_DOCS, most: int = MAX_PARAGRAPHS) -> Model:
    """Takes paragraphs of a bounded sample of docs that share next to nothing with a template as unknown: by hash
    from the whole texts, at most so many of those that are like the ones that a scan classifies, and of the others."""
    rows = docs.where(F.length("text") > 0).select("text")
    total = rows.count()
    number = draw(F.col("text"))
    sample = rows.where(number < F.lit(min(1.0, 1.2 * bound / max(total, 1)))).orderBy(number).limit(bound)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = [(p, n) for p in {text[a:b] for a, b in paragraphs(text)} if p.strip() and (n := _shared_grams(p)) < 3]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n > 0 for _, n in found], pa.bool_())], names=["paragraph", "close"])

    every = stored(sample.mapInArrow(cut, "paragraph string, close boolean").distinct(), "paragraphs")
    found = [r["paragraph"] for close in (True, False) for r in every.where(F.col("close") == close).orderBy(draw(F.col("paragraph")), "paragraph").limit(most).collect()]
    return train(found[::2], found[1::2])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with licences: array of (family, start, end, chance), by start."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    own = docs.drop("licences")
    names = ("family", "start", "end", "chance")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in shared.value.statements(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "licences"])

    added = StructType.fromDDL("licences array<struct<family:string,start:bigint,end:bigint,chance:double>>")
    return own.mapInArrow(run, StructType([*own.schema.fields, *added.fields]))


def op7_licences(docs: DataFrame) -> DataFrame:
    found = F.col("licences")
    listed = F.transform(found, lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["end"].cast("string")))
    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "doc_id",
        F.size(found).cast("long").alias("n_statements"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["family"]))), ",").alias("families"),
        F.array_join(listed, ",").alias("spans"),
    )
