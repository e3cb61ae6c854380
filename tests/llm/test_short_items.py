"""Benchmark items of one to nine words, by brute force."""

from __future__ import annotations

import random
import re

from tidemark.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_short_items_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "d", "é", "E"])
    items = [(i, " ".join(word() for _ in range(1 + i % 12))) for i in range(30)]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    lower = lambda t: WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
    for most in (0, 1000):
        found = {
            r["doc_id"]: r
            for r in decontamination.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=most).collect()
        }
        for i, text in docs:
            words, spans, ids = lower(text), set(), set()
            for item, t in items:
                own = lower(t)
                n = min(10, len(own))
                windows = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)}
                for j in range(len(words) - n + 1):
                    if tuple(words[j : j + n]) in windows:
                        spans.add((j + 1, j + n))
                        ids.add(item)
            got = found.get(i)
            assert (set(map(tuple, got["spans"])) if got else set()) == spans
            assert (set(got["items"]) if got else set()) == ids
