"""Expected piece counts and whole-text scores against enumeration; the bound of the broadcast words."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import scoring
from tidemark.llm.scoring import MARK, Lattice


@pytest.fixture(scope="module")
def lattice():
    return Lattice(scoring.default_vocabulary())


def paths(lattice, word, at=0):
    """All segmentations as (chance, pieces)."""
    if at == len(word):
        yield 1.0, ()
        return
    for stop in range(at + 1, len(word) + 1):
        piece = lattice.ids.get(word[at:stop])
        pieces = (piece,) if piece is not None else lattice.spelled(word[at]) if stop == at + 1 else None
        if pieces:
            own = math.prod(lattice.chances[b] for b in pieces)
            for chance, rest in paths(lattice, word, stop):
                yield own * chance, pieces + rest


@pytest.mark.parametrize("word", ["river", "ñandú", "日x", "the", "aaaaaa"])
def test_expected_counts_by_enumeration(lattice, word):
    found = list(paths(lattice, MARK + word))
    total = sum(c for c, _ in found)
    want = [0.0] * len(lattice.logs)
    for chance, pieces in found:
        for p in pieces:
            want[p] += 3.0 * chance / total
    for expect in (lattice.expect, lattice._expect_in_logs):
        got = [0.0] * len(want)
        expect(word, 3.0, got)
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-15) for a, b in zip(got, want, strict=True))
    assert math.isclose(lattice.forward(word), math.log(total), rel_tol=1e-9)


@pytest.mark.parametrize("n", [63, 64, 65, 200, 5000])
def test_long_words_are_one_word(lattice, n):
    word = ("stonebridge" * n)[:n]
    by_product, by_logs = [0.0] * len(lattice.logs), [0.0] * len(lattice.logs)
    lattice.expect(word, 1.0, by_product)
    lattice._expect_in_logs(word, 1.0, by_logs)
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(by_product, by_logs, strict=True))
    starts = sum(c for name, p in lattice.ids.items() if name.startswith(MARK) for c in [by_logs[p]])
    starts += by_logs[lattice.bytes[MARK.encode()[0]]] if MARK not in lattice.ids else 0
    assert math.isclose(starts, 1.0, rel_tol=1e-6)


def test_whole_texts_by_a_plain_sum(spark):
    rows = [(i, t) for i, t in enumerate(["the river the stone", "The RIVER 日x", "", None, "aaaaaa the the"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in scoring.score(docs, F.col("doc_id") != 1).collect()}
    path = scoring.default_vocabulary()
    _, first, end = scoring._pieces(path)
    before, sums = Lattice(path), scoring.PRIOR * first
    for i, t in rows:
        if i != 1:
            sums[end] += 1
            for w in (t or "").lower().split():
                every = list(paths(before, MARK + w))
                total = sum(c for c, _ in every)
                for chance, pieces in every:
                    for p in pieces:
                        sums[p] += chance / total
    after = Lattice(path, sums / sums.sum())
    for i, t in rows:
        want = after.logs[end] + sum(math.log(sum(c for c, _ in paths(after, MARK + w))) for w in (t or "").lower().split())
        assert math.isclose(found[i]["score"], want / math.log(10), rel_tol=1e-9)


def test_the_broadcast_words_hold_their_bound(spark):
    same = spark.range(50).select(F.format_string("w%d", "id").alias("token"), F.lit(70_000).cast("long").alias("n"))
    head, others = scoring._head(same, 10)
    assert len(head) <= 10 and len(head) + others.count() == 50
    rising = spark.range(1, 2001).select(F.format_string("w%d", "id").alias("token"), (F.col("id") * F.col("id")).alias("n"))
    head, others = scoring._head(rising, 500)
    assert 400 <= len(head) <= 500 and others.count() == 2000 - len(head)
    assert min(head.values()) * 2 >= others.agg(F.max("n")).first()[0]
    assert scoring._head(same.limit(0), 5)[0] == {}
