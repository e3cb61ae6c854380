"""Near copies: balls around segments, and comparisons that do not grow with the square of a group."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import near_copies


def test_balls_of_radius_1(spark):
    """Fingerprints that differ in one bit of each wide segment and in two of the others meet; with three there they do not."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, near_copies.SEGMENTS * near_copies.BITS, np.uint8)
    flipped = []
    for wide in (1, 3):
        other = base.copy()
        for i in range(near_copies.SEGMENTS):
            at = i * near_copies.BITS + rng.choice(near_copies.BITS, wide if i < near_copies.WIDE else 2, replace=False)
            other[at] ^= 1
        flipped.append(other)
    rows = [(i, 9, np.packbits(b, bitorder="little").view("<i8").tolist()) for i, b in enumerate([base, *flipped])]
    found = near_copies.buckets(spark.createDataFrame(rows, "mark long, size int, print array<long>"))
    met = {tuple(sorted(r["marks"])) for r in found.groupBy("key").agg(F.collect_set("mark").alias("marks")).collect()}
    assert (0, 1) in met and not any({0, 2} <= set(m) for m in met)


def _similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_large_group_is_not_paired(spark, monkeypatch):
    """Copies of one text with up to a sixth of the words replaced: a third are near copies of it, the others of none."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        own = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 9, 12, 15))):
            own[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    compared, alike = [], near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in rows}
    root = dict.fromkeys(sets)
    for i in sets:
        if root[i] is None:
            root[i], todo = i, [i]
            while todo:
                own = todo.pop()
                for j in sets:
                    if root[j] is None and _similar(sets[own], sets[j]):
                        root[j] = i
                        todo.append(j)
    assert found == root and len(set(root.values())) > 100
    assert sum(compared) <= 4 * len(rows)


def test_prefix_pairs_by_brute_force(spark):
    """Every pair of similar sets with different roots is found, sets of one to sixty shingles."""
    rng = random.Random(2)
    rows = []
    for i in range(150):
        own = set(rng.sample(range(60), rng.randrange(1, 60))) if i % 2 == 0 else set(rows[-1][2]) ^ set(rng.sample(range(60), rng.randrange(0, 5)))
        rows.append((i, i % 7, sorted(own or {1})))
    found = {(r["x"], r["y"]) for r in near_copies.prefix_pairs(spark.createDataFrame(rows, "mark long, root long, found array<long>")).collect()}
    want = {(a, b) for a, r, x in rows for b, q, y in rows if a < b and r != q and _similar(set(x), set(y))}
    assert len(want) > 40 and want <= found
