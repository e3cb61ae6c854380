"""Quality by supervised subword embeddings.

Every hashed word, pair of words and character n-gram has a learned vector; a text is the average of the vectors of
its grams, and a softmax layer over the average gives the chance of either label. Vectors and layer
are fitted together by stochastic gradient descent in numpy on a bounded sample of labelled texts.

The layer is linear in the average, so for scoring every vector is reduced beforehand to the number
it adds to the difference of the two outputs: a text's score needs one look-up for each gram.

Defined results: a null or empty text has the average zero, so it gets the layer's own offset; with
labels of one class only, or none, every score is the share of label 1 (0.5 without any); several
labels of a doc_id are all learned from; rows are scored as often as they come; an empty table gives
an empty result; further columns are ignored. Texts are scored whole, in pieces that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gram_buckets, labelled_sample, packed_counts, remainder, sigmoid, word_buckets

FOLDS = 5
#: Labelled texts that are learned from, at most; half of them of either class if both have so many.
MAX_TRAIN_DOCS = 4000
THRESHOLD = 0.3
SIZES = (2, 3, 4)
BITS, WORD_BITS = 15, 14
DIMENSIONS = 10
EPOCHS = 6


class Model:
    """weights: what each bucket adds to the log odds of label 1, times its share of the text's grams; offset; share of label 1."""

    def __init__(self, weights: np.ndarray, offset: float, share: float):
        self.weights, self.offset, self.share = weights.astype(np.float32), offset, share

    def score(self, text: str | None) -> float:
        text, total, n = text or "", 0.0, 0
        for buckets in gram_buckets(text, SIZES, BITS):
            total += float(self.weights[buckets].sum(dtype=np.float64))
            n += len(buckets)
        found = word_buckets(text, WORD_BITS)
        total += float(self.weights[found + np.uint32(1 << BITS)].sum(dtype=np.float64))
        return float(sigmoid(self.offset + total / max(n + len(found), 1)))


def train(rows: list[tuple], share: float | None = None, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """rows: (label, buckets, counts). share: of label 1 among all labelled texts, if rows are balanced.

    One text at a time; AdaGrad keeps a rate for each bucket, as frequent grams get many small steps.
    """
    labels = np.array([label for label, _, _ in rows], int)
    size = (1 << BITS) + (1 << WORD_BITS)
    share = (float(labels.mean()) if len(labels) else 0.5) if share is None else share
    if len(set(labels.tolist())) < 2:
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(np.zeros(size), float(odds), share)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer, offset = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    seen, seen_layer = np.full(size, 1e-4, np.float32), np.full((DIMENSIONS, 2), 1e-3, np.float32)
    shares = [(counts / counts.sum()).astype(np.float32) if len(counts) else counts for _, _, counts in rows]
    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            at, part = rows[i][1], shares[i]
            average = part @ vectors[at]
            out = average @ layer + offset
            out = np.exp(out - out.max())
            miss = out / out.sum()
            miss[labels[i]] -= 1
            back = layer @ miss
            step = np.outer(average, miss)
            seen_layer += step * step
            layer -= rate * step / np.sqrt(seen_layer)
            offset -= 0.1 * rate * miss
            seen[at] += part * part * (back @ back)
            vectors[at] -= (rate * part / np.sqrt(seen[at]))[:, None] * back
    share = min(max(share, 1e-6), 1 - 1e-6)
    prior = np.log(share / (1 - share)) - np.log(labels.mean() / (1 - labels.mean()))
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(offset[1] - offset[0] + prior), share)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN_DOCS) -> Model:
    """Learns from a sample of at most bound labelled texts outside the held-out fold, whatever the rows of an id."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(remainder(F.col("doc_id"), FOLDS) != 0)
    share = known.agg(F.avg("quality")).first()[0]
    rows = packed_counts(labelled_sample(docs, known, "quality", bound), "quality", SIZES, BITS, WORD_BITS)
    return train(sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())), share)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op3_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = classify(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
