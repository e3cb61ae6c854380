"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier over hashed character n-grams predicts each
bit. A text gets the language whose codeword has the least summed logistic loss, and is flagged as
ambiguous when the second best is about as near.

Defined results: a null text, or one without a letter, is `und` with score 0; with no labelled row
everything is `und`; with one language every text with letters gets it. Rows are kept as often as
they come; ties between languages go to the smaller name; an empty table gives an empty result;
further columns are ignored. Texts are read whole, in pieces that overlap.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import bounded_sample, packed_counts, remainder, text_counts

SIZES = (1, 2, 3)
BITS = 13
FOLDS = 5
UNKNOWN = "und"
#: Texts that the classifiers are fitted on, at most; they are shared evenly by the languages, and a language
#: with fewer texts than an even share gives all of them. With more languages than this, the rarest are not learned.
MAX_TRAIN_DOCS = 2400
#: A text is flagged as ambiguous if its best decoding score is below so many times an even share (0.5 at most).
AMBIGUOUS = 1.4
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def codewords(classes: int, seed: int = 10) -> np.ndarray:
    """classes x bits of -1 and 1: all distinct splits up to 6 classes, else the best of some random codes."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        return np.array([[-1 if column >> row & 1 else 1 for column in range(1, 1 << (classes - 1))] for row in range(classes)], float)
    rng, best, widest = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (classes, 15 * math.ceil(math.log2(classes))))
        if (np.abs(code.sum(0)) == classes).any():
            continue
        alike = code @ code.T
        apart = (code.shape[1] - np.max(alike - 2 * code.shape[1] * np.eye(classes))) / 2
        if apart > widest:
            best, widest = code, apart
    return best


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the n-gram counts, at unit length."""
    x = np.sqrt(counts)
    norm = np.linalg.norm(x)
    return x / norm if norm else x


class Model:
    """languages (sorted), their codewords, and weights (buckets + 1, bits)."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray):
        self.languages, self.code, self.weights = languages, code, weights

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, decoding score from 0 to 1, whether it is ambiguous."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        bits = features(text_counts(text, SIZES, BITS)) @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -self.code * bits).sum(axis=1)
        chance = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        score = float(1 / chance.sum())
        return self.languages[best], score, score < min(0.5, AMBIGUOUS / len(self.languages))


def train(rows: list[tuple], epochs: int = 12, seed: int = 10) -> Model:
    """Logistic bit classifiers, all at once, by AdaGrad over mini-batches of (language, buckets, counts)."""
    labels = [language for language, _, _ in rows]
    languages = sorted(set(labels))
    code = codewords(len(languages))
    weights = np.zeros(((1 << BITS) + 1, code.shape[1] if languages else 1), np.float32)
    if len(languages) > 1:
        x = np.zeros((len(rows), len(weights)), np.float32)
        for own, (_, at, counts) in zip(x, rows, strict=True):
            own[at], own[-1] = features(counts), 1
        y = code[[languages.index(v) for v in labels]].astype(np.float32)
        rng, seen = np.random.default_rng(seed), np.full_like(weights, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), 64):
                rows = order[at : at + 64]
                miss = -y[rows] / (1 + np.exp(np.clip(y[rows] * (x[rows] @ weights), -30, 30)))
                step = x[rows].T @ miss / len(rows) + 1e-6 * weights
                seen += step * step
                weights -= 0.5 * step / np.sqrt(seen)
    return Model(languages, code, weights)


def fit(docs: DataFrame, bound: int = MAX_TRAIN_DOCS) -> Model:
    """Learns from text and lang of rows outside the held-out fold, by a bounded sample of them."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0))
    return train(packed_counts(bounded_sample(rows, "lang", bound, F.col("doc_id"), F.xxhash64("text")), "lang", SIZES, BITS))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with lang_pred, lang_score and lang_ambiguous added; docs' own columns of these names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(docs))
    added = "lang_pred string, lang_score double, lang_ambiguous boolean"
    own = docs.drop("lang_pred", "lang_score", "lang_ambiguous")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_ambiguous"])

    return own.mapInArrow(run, StructType([*own.schema.fields, *StructType.fromDDL(added).fields]))


def op10_language(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is found without ambiguity, with docs' columns."""
    return identify(docs).where(~F.col("lang_ambiguous")).select(*[f"`{c}`" for c in docs.columns])
