"""Toxicity by class-conditional Kneser-Ney models of word sequences.

A toxic and an ordinary model give the chance of each word of a text after the word before it. Both are
interpolated Kneser-Ney models over continuation counts: a pair counts once for each distinct word
before it, a word once for each distinct word before it, so passages copied many times count once. Counts
are discounted and the rest is left to the order below: pairs back off to the class's own words, and these
to the words of both classes together, so expressions that are rare in both classes say next to nothing.

With r(w) the logarithm of a word's chance under the toxic model over that under the ordinary one, a text
is described by two length-normalised log-likelihood ratios: the mean of r over the whole text, and the
largest mean of r over an expression of 1 to SPAN words in it, so one abusive expression shows in a long
text. A logistic function of both, fitted on texts that the models have not seen, is the score.

Defined results: a null text, or one without words, has both ratios 0; without labels of both classes
every score is the share of toxic labels (0.5 without any); several labels of a doc_id are all learned
from; rows are scored as often as they come; an empty table gives an empty result; further columns are
ignored. Texts are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import labelled_sample, remainder, sigmoid, stored

FOLDS = 5
#: Labelled texts that are learned from, at most; half of them of either class if both have so many.
MAX_TRAIN_DOCS = 2400
THRESHOLD = 0.5
#: Words of an expression, at most.
SPAN = 3
#: Parts of the sample; models of all but one part score that part.
PARTS = 5
#: The discount of word counts is one for so many texts of the smaller class, at least 1; that of pairs is PAIRS
#: times as large. A word or pair tells the classes apart only if it comes after more different words than that.
TEXTS_A_DISCOUNT = 75
PAIRS = 8
#: Discount of the words of both classes together.
SHARED = 0.75
#: Words, and pairs, that a model holds, at most; the most frequent ones.
MAX_GRAMS = 300_000
#: Words of a text that are looked at at once.
BLOCK = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall((text or "").lower())


class Counts:
    """Continuation counts of one set of texts, by class 0 and 1.

    singles: word to (count in ordinary texts, in toxic texts, in both together); pairs: (before, word) to
    (ordinary, toxic); followed: before to (ordinary, toxic), the sum over all pairs of that first word.
    spent: what the discount takes from the word counts of either class; total: these counts' sum; shared:
    the sum of the counts of both classes together, and the number of words.
    """

    def __init__(self, discount: int, singles: dict, pairs: dict, followed: dict, spent: tuple, total: tuple, shared: tuple):
        self.discount, self.singles, self.pairs, self.followed, self.spent, self.total, self.shared = discount, singles, pairs, followed, spent, total, shared


class Model:
    """The logarithm of a word's chance in toxic texts over that in ordinary ones, given the word before it."""

    def __init__(self, counts: Counts):
        discount, listed = counts.discount, sorted(counts.singles)
        self.ids = {w: i + 1 for i, w in enumerate(listed)}
        n = np.array([counts.singles[w] for w in listed], float).reshape(-1, 3)
        every, distinct = counts.shared
        base = np.concatenate([[0.0], np.maximum(n[:, 2] - SHARED, 0) / max(every, 1)]) + SHARED * distinct / max(every, 1) / (distinct + 1) + 1e-12
        self.one = np.zeros((2, len(listed) + 1))
        for c in (0, 1):
            total = max(counts.total[c], 1)
            spare = counts.spent[c] / total if counts.total[c] else 1.0
            self.one[c] = max(spare, 1e-9) * base
            self.one[c, 1:] += np.maximum(n[:, c] - discount, 0) / total
        kept = {p: k for p, k in counts.pairs.items() if max(k) > PAIRS * discount and p[1] in self.ids and p[0] in counts.followed}
        firsts = sorted({a for a, _ in kept})
        #: of each word as the one before: its place among the histories that have a pair, 0 for the others
        self.history = {a: i + 1 for i, a in enumerate(firsts)}
        self.spare = np.ones((2, len(firsts) + 1))
        order = sorted((self.history[a] * (len(listed) + 1) + self.ids[w], a, k) for (a, w), k in kept.items())
        self.keys = np.array([key for key, _, _ in order], np.int64)
        self.two = np.zeros((2, len(order) + 1))
        for at, (key, a, k) in enumerate(order):
            for c in (0, 1):
                if counts.followed[a][c] and k[c] > PAIRS * discount:
                    self.two[c, at] = (k[c] - PAIRS * discount) / counts.followed[a][c]
                    self.spare[c, key // (len(listed) + 1)] -= self.two[c, at]
        self.spare = np.maximum(self.spare, 1e-6)

    def chances(self, listed: list[str], before: str = "") -> np.ndarray:
        """(2, words): chance of each word under the ordinary and the toxic model."""
        at = np.array([self.ids.get(w, 0) for w in listed], np.int64)
        one = self.one[:, at]
        if not len(self.keys):
            return one
        history = np.array([self.history.get(w, 0) for w in [before, *listed[:-1]]], np.int64)
        key = history * self.one.shape[1] + at
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        place = np.where((self.keys[place] == key) & (history > 0), place, len(self.keys))
        return self.two[:, place] + self.spare[:, history] * one

    def evidence(self, found: list[str]) -> tuple[float, float]:
        """The mean ratio of the text, and the largest mean of an expression in it."""
        total, best, tail, before = 0.0, -np.inf, np.zeros(0), ""
        for start in range(0, len(found), BLOCK):
            some = found[start : start + BLOCK]
            chance = np.log(self.chances(some, before))
            ratio, before = chance[1] - chance[0], some[-1]
            total += float(ratio.sum())
            joined = np.concatenate([tail, ratio])
            sums = np.concatenate([[0.0], np.cumsum(joined)])
            for n in range(1, min(SPAN, len(joined)) + 1):
                best = max(best, float((sums[n:] - sums[:-n]).max()) / n)
            tail = joined[len(joined) - SPAN + 1 :] if len(joined) >= SPAN else joined
        return (total / len(found), best) if found else (0.0, 0.0)


class Classifier:
    def __init__(self, model: Model | None, weights: np.ndarray, share: float):
        self.model, self.weights, self.share = model, weights, share

    def score(self, text: str | None) -> float:
        if self.model is None:
            return self.share
        return float(sigmoid(np.dot(self.weights, (*self.model.evidence(words(text)), 1.0))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the columns and an offset by Newton steps with a small ridge."""
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = sigmoid(a @ w)
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - 1e-3 * w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (two words before, word before, word) of each text, with its part and label."""
    names = ("own", "toxic", "second", "first", "word")
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
    for batch in batches:
        for own, label, text in zip(batch.column("own").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
            found = words(text.as_py())
            for at in range(0, len(found), BLOCK):
                ahead = ["", "", *found[:at]][-2:]
                some = [*ahead, *found[at : at + BLOCK]]
                met = list(set(zip(some, some[1:], some[2:], strict=False)))
                columns = ([own] * len(met), [label] * len(met), *(zip(*met, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def count(rows: DataFrame, discount: int) -> list[Counts]:
    """Continuation counts of the texts without part 0, without part 1 and so on, and of all texts, from rows
    of own (the part of a text), toxic, text.

    A triple is kept once with the set of parts that have it, as bits. The driver sees at most MAX_GRAMS words
    and pairs, those that the discount leaves something of.
    """
    met = rows.mapInArrow(_triples, "own int, toxic int, second string, first string, word string")
    met = met.withColumns({"second": F.xxhash64("second"), "bit": F.expr("shiftleft(1, own)")})
    met = met.groupBy("toxic", "second", "first", "word").agg(F.bit_or("bit").alias("mask"))
    every = range(PARTS + 1)
    there = lambda p: F.col("mask").bitwiseAND(F.lit(((1 << PARTS) - 1) & ~(1 << p))) != 0
    pairs = met.groupBy("first", "word").agg(*(F.count_if((F.col("toxic") == c) & there(p)).alias(f"n{c}_{p}") for p in every for c in (0, 1)))
    pairs = stored(pairs, "pairs")
    has = lambda c, p: F.col(f"n{c}_{p}") > 0
    singles = pairs.groupBy("word").agg(
        *(F.count_if(has(c, p)).alias(f"n{c}_{p}") for p in every for c in (0, 1)), *(F.count_if(has(0, p) | has(1, p)).alias(f"s_{p}") for p in every)
    )
    singles = stored(singles, "words")
    sums = [F.sum(f"n{c}_{p}").alias(f"n{c}_{p}") for p in every for c in (0, 1)] + [F.sum(F.least(f"n{c}_{p}", F.lit(discount))).alias(f"spent{c}_{p}") for p in every for c in (0, 1)]
    t = singles.agg(*sums, *(F.sum(f"s_{p}").alias(f"s_{p}") for p in every), *(F.count_if(F.col(f"s_{p}") > 0).alias(f"d_{p}") for p in every)).first()
    largest = F.greatest(f"n0_{PARTS}", f"n1_{PARTS}")
    kept = stored(pairs.where(largest > PAIRS * discount), "kept")
    followed = pairs.join(kept.select("first").distinct(), "first", "left_semi").groupBy("first").agg(*(F.sum(f"n{c}_{p}").alias(f"n{c}_{p}") for p in every for c in (0, 1)))
    paired = kept.select("word", F.lit(True).alias("paired")).distinct()
    telling = singles.join(paired, "word", "left").where((largest > discount) | F.col("paired")).drop("paired")
    most = lambda df, *key: df.orderBy(F.desc(largest), *key).limit(MAX_GRAMS).collect()
    one, two, after = most(telling, "word"), most(kept, "first", "word"), most(followed, "first")
    both = lambda r, p, name="n": (r[f"{name}0_{p}"] or 0, r[f"{name}1_{p}"] or 0)
    return [
        Counts(
            discount,
            {r["word"]: (*both(r, p), r[f"s_{p}"]) for r in one},
            {(r["first"], r["word"]): both(r, p) for r in two},
            {r["first"]: both(r, p) for r in after},
            both(t, p, "spent"),
            both(t, p),
            (t[f"s_{p}"] or 0, t[f"d_{p}"]),
        )
        for p in every
    ]


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN_DOCS) -> Classifier:
    """Learns from a sample of at most bound labelled texts outside the held-out fold.

    The sample is dealt into PARTS by hash; models of all but one score that one, which calibrates the score.
    """
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(remainder(F.col("doc_id"), FOLDS) != 0)
    share = known.agg(F.avg("toxic")).first()[0]
    share = 0.5 if share is None else float(share)
    own = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int")
    rows = stored(labelled_sample(docs, known, "toxic", bound).select(own.alias("own"), "toxic", "text"), "labelled")
    texts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(texts) < 2:
        return Classifier(None, np.zeros(3), share)
    counts = count(rows, max(1, round(min(texts.values()) / TEXTS_A_DISCOUNT)))
    others = spark.sparkContext.broadcast(counts[:PARTS])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model = None, None
        for batch in batches:
            found = []
            for part, text in zip(batch.column("own").to_pylist(), batch.column("text"), strict=True):
                if part != at:
                    at, model = part, Model(others.value[part])
                found.append(model.evidence(words(text.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "x"])

    apart = rows.repartition(PARTS, "own").sortWithinPartitions("own")
    scored = sorted((r["toxic"], r["x"]) for r in apart.mapInArrow(crossed, "toxic int, x array<double>").collect())
    others.destroy()
    y, x = np.array([label for label, _ in scored], float), np.array([found for _, found in scored])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Classifier(Model(counts[PARTS]), _logistic(x, y, weight), share)


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = classify(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
