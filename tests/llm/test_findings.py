"""The whole job where a cut was found: near copies, neighbours of large tables, licences of any line, letter-only keys."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import licences, near_copies, neighbours


def _near(spark):
    """Texts, and copies of them with up to 14 of 200 words changed, which leaves a similarity of 0.86 or more, or
    with 25 to 40 changed, which leaves less than 0.8."""
    rng = random.Random(3)
    rows = []
    for i in range(80):
        own = [f"w{rng.randrange(5000)}" for _ in range(200)]
        n = 1 + i % 14 if i % 2 else 25 + i % 16
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-n] + [f"v{i}x{j}" for j in range(n)]))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_pipeline_drops_near_copies_of_similarity_0_8(spark):
    rows, docs = _near(spark)
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in rows}
    want = {i for i in sets if i % 2 == 0 or len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) < 0.8}
    assert len(want) == 120
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, "").collect()} == want


def test_fingerprints_and_segments_by_plain_bits():
    found = near_copies.shingles(" ".join(f"w{i % 37} x{i}" for i in range(400)))
    bits = near_copies.long_fingerprint(found)
    mask = (1 << 64) - 1
    for k in (0, 1, 97):
        ones = [0] * 64
        for h in found.tolist():
            m = h ^ (k + 1) * 0x9E3779B97F4A7C15 & mask
            m = (m ^ m >> 30) * 0xBF58476D1CE4E5B9 & mask
            m = (m ^ m >> 27) * 0x94D049BB133111EB & mask
            m ^= m >> 31
            ones = [n + (m >> b & 1) for b, n in enumerate(ones)]
        assert bits[64 * k : 64 * k + 64].tolist() == [2 * n > len(found) for n in ones]
    keys = near_copies.segments(bits[None])[0]
    assert len(set(keys.tolist())) == near_copies.SEGMENTS
    assert keys[3] == 3 << near_copies.BITS | sum(int(bits[3 * near_copies.BITS + b]) << b for b in range(near_copies.BITS))


def test_share_of_pairs_that_meet():
    """Pairs of sets of known similarity meet about as often as the docstring says."""
    rng = np.random.default_rng(6)
    for kept, least in ((178, 0.80), (190, 0.97)):  # of 200: similarity 0.80 and 0.905
        met = 0
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 400 - kept, dtype=np.int64).astype(np.uint64)
            a, b = near_copies.long_fingerprint(both[:200]), near_copies.long_fingerprint(both[200 - kept :])
            assert (a[:256] != b[:256]).sum() <= near_copies.DISTANCE
            met += bool((near_copies.segments(a[None]) == near_copies.segments(b[None])).any())
        assert met / 60 >= least, kept


def test_near_copies_meet_away_from_the_ends_of_a_band(spark):
    """A chain of neighbours at 0.8 or more is one component though its ends are far apart."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(9000)}" for _ in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(20)]
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}


def test_neighbours_window_grows_with_the_table(spark):
    """Blocks that are small against the table: the window is a share of the table, not three of them."""
    for total in (51_282, 200_000, 600_000, 50_000_000):
        block, beside = neighbours.window(total)
        assert block <= neighbours.MOST and beside * block >= neighbours.SHARE * total
    x = np.random.default_rng(2).normal(size=(3000, 16))
    found = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=8).collect()
    hits = 0
    for i in range(0, 3000, 50):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in found if r["query_id"] == i})
    assert hits / 600 >= 0.9


def test_licences_of_any_line():
    model = licences.train([], [])
    named = lambda text: {s[0] for s in model.statements(text)}
    assert named("Released under the GPL v3.") == {"gpl-3.0"}
    prose = "the river ran by the garden and people came in the morning to see the stone bridge over the water "
    for n in range(340, 400, 4):
        assert "apache-2.0" in named("He asked for permission to go. " + (prose * 9)[:n] + " Licensed under the Apache License, Version 2.0."), n
        assert "apache-2.0" in named((prose * 9)[:n] + " Licensed under the Apache License, Version 2.0. " + prose * 20), n
    assert named("Licensed under the MIT license. Licensed under the Apache License, Version 2.0.") == {"mit", "apache-2.0"}
    for family, texts in licences.TEMPLATES.items():
        assert all(named(t) == {family} for t in texts), family
    assert not any(named(t) for t in licences.ORDINARY)
