"""Language-model scores of documents: marginal likelihood over all subword segmentations.

The pieces of an existing vocabulary are the model's symbols. Their published scores give the first
weights; one expectation step over the word counts of all training documents re-estimates them. A
word's probability sums over all its segmentations into pieces (log-space forward recursion); pieces
do not span words, so a document's log probability is the sum over its words and its end. Characters
that are no piece are spelled in byte pieces.

A smoothed unigram word model is scored beside it. Counts of frequent words (a bounded number) are
broadcast; the other words of a document are matched to their counts by a join, so the vocabulary
may grow with the corpus.

Defined results: a null text is the empty text, whose only token is the end; rows are scored as often
as they come; a null doc_id counts as the empty text for the hold-out and is learned from; with no
training rows every count is 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remainder, stored

FOLDS, HELD_OUT = 7, 2
#: Stands for the end of a document among the counted tokens; no word is empty.
END = ""
MARK = "▁"
#: Words whose counts are broadcast, at most.
HEAD = 100_000
#: Distinct words that a task counts before it hands its counts on.
FLUSH = 150_000
#: Sums of products below this are taken by logarithms.
FAINT = 1e-250
#: Weight, in pieces, of the vocabulary's own scores beside the corpus' expected counts.
PRIOR = 2000.0


def tokens(text: str | None) -> list[bytes]:
    """Words split at the six ASCII white-space characters, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@cache
def _pieces(path: str) -> tuple[list[str], np.ndarray, int]:
    """The vocabulary's pieces (byte pieces as <0xHH>), their first weights, the id of the end piece.

    The scores of a merge vocabulary are negated ranks; 1 / (1 + rank) turns them into weights.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    weights = np.array([0.0 if model.is_unknown(i) or model.is_control(i) else 1.0 / (1.0 + max(0.0, -model.get_score(i))) for i in range(n)])
    weights[model.eos_id()] = weights.max()
    return [model.id_to_piece(i) for i in range(n)], weights / weights.sum(), model.eos_id()


def default_vocabulary() -> str:
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


class Lattice:
    """Sums over the segmentations of words."""

    def __init__(self, path: str, weights: np.ndarray | None = None):
        names, first, self.end = _pieces(path)
        with np.errstate(divide="ignore"):
            self.logs = np.log(first if weights is None else weights).tolist()
        self.chances = (first if weights is None else weights).tolist()
        self.ids = {name: i for i, name in enumerate(names) if i != self.end and not name.startswith("<0x") and self.logs[i] > -math.inf}
        self.bytes = [self.ids_of_byte(names, b) for b in range(256)]
        self.longest = max(map(len, self.ids), default=1)

    @staticmethod
    def ids_of_byte(names: list[str], b: int) -> int:
        return 3 + b if names[3 + b] == f"<0x{b:02X}>" else names.index(f"<0x{b:02X}>")

    def spelled(self, char: str) -> tuple[int, ...]:
        return tuple([self.bytes[b] for b in char.encode("utf-8", "surrogatepass")])

    def forward(self, word: str) -> float:
        """Log probability of the word, summed over all its segmentations."""
        word = MARK + word
        ids, logs, longest, n, exp, log1p = self.ids, self.logs, self.longest, len(word), math.exp, math.log1p
        ahead: list[float | None] = [None] * (n + 1)
        ahead[0] = 0.0
        for i in range(n):
            here = ahead[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = ids.get(word[i:j])
                if piece is not None:
                    new = here + logs[piece]
                elif j == i + 1:
                    new = here + sum([logs[b] for b in self.spelled(word[i])])
                else:
                    continue
                old = ahead[j]
                if old is None:
                    ahead[j] = new
                elif new > old:
                    ahead[j] = new + log1p(exp(old - new))
                else:
                    ahead[j] = old + log1p(exp(new - old))
        return ahead[n]

    def _steps(self, word: str, i: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(end, pieces) of the steps from i: a piece of the vocabulary, or one character in byte pieces."""
        for j in range(i + 1, min(len(word), i + self.longest) + 1):
            piece = self.ids.get(word[i:j])
            if piece is not None:
                yield j, (piece,)
            elif j == i + 1:
                yield j, self.spelled(word[i])

    def expect(self, word: str, weight: float, counts: list[float]) -> None:
        """Add to counts how often each piece is expected in so many occurrences of the word.

        Sums of products where they stay in the range of doubles, else the same sums of logarithms.
        """
        whole, word = word, MARK + word
        ids, chances, longest, n = self.ids, self.chances, self.longest, len(word)
        ahead = [0.0] * (n + 1)
        ahead[0] = 1.0
        edges = []
        for i in range(n):
            here = ahead[i]
            if here < FAINT:
                return self._expect_in_logs(whole, weight, counts)
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = ids.get(word[i:j])
                if piece is not None:
                    pieces, chance = (piece,), chances[piece]
                elif j == i + 1:
                    pieces = self.spelled(word[i])
                    chance = math.prod([chances[b] for b in pieces])
                else:
                    continue
                edges.append((i, j, pieces, chance))
                ahead[j] += here * chance
        if ahead[n] < FAINT:
            return self._expect_in_logs(whole, weight, counts)
        behind = [0.0] * (n + 1)
        behind[n] = weight / ahead[n]
        for i, j, pieces, chance in reversed(edges):
            on = chance * behind[j]
            behind[i] += on
            for b in pieces:
                counts[b] += ahead[i] * on

    def _expect_in_logs(self, word: str, weight: float, counts: list[float]) -> None:
        word = MARK + word
        logs, n = self.logs, len(word)
        ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = behind[n] = 0.0
        for i in range(n):
            for j, pieces in self._steps(word, i):
                ahead[j] = _log_sum(ahead[j], ahead[i] + sum([logs[b] for b in pieces]))
        for i in range(n - 1, -1, -1):
            for j, pieces in self._steps(word, i):
                chance = sum([logs[b] for b in pieces])
                behind[i] = _log_sum(behind[i], chance + behind[j])
                often = weight * math.exp(ahead[i] + chance + behind[j] - ahead[n])
                for b in pieces:
                    counts[b] += often


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            words = tokens(text.as_py())
            for at in range(0, len(words), FLUSH):
                counts.update(words[at : at + FLUSH])
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts = Counter()
            counts[b""] += 1
    if counts:
        yield rows(counts)


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n over all rows of docs; END counts the rows."""
    return docs.select("text").mapInArrow(_counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def estimate(counts: DataFrame, path: str, prior: float = PRIOR) -> np.ndarray:
    """Piece probabilities after one expectation step over all counted words."""

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path)
        sums = [0.0] * len(lattice.logs)
        for batch in batches:
            for token, n in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if token == END:
                    sums[lattice.end] += n
                else:
                    lattice.expect(token, n, sums)
        some = [i for i, n in enumerate(sums) if n]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([sums[i] for i in some], pa.float64())], names=["piece", "n"])

    _, first, _ = _pieces(path)
    sums = prior * first
    for row in counts.mapInArrow(expected, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        sums[row["piece"]] += row["n"]
    return sums / sums.sum()


def _head(counts: DataFrame, bound: int) -> tuple[dict[str, int], DataFrame]:
    """The counts of at most bound words, the most frequent ones, and the counts of the others.

    The driver sees a histogram of the counts by powers of two and, within the power that the bound falls
    in, by hash; words are collected by both, so ties do not go beyond the bound.
    """
    level = F.floor(F.log2("n")).cast("int")
    within = F.pmod(F.xxhash64("token"), F.lit(1 << 10)).cast("int")
    # ordered by (level descending, slot ascending): a word's place in that order
    sizes = {(r["level"], r["slot"]): r["n_words"] for r in counts.groupBy(level.alias("level"), within.alias("slot")).agg(F.count("*").alias("n_words")).collect()}
    held, last = 0, None
    for at in sorted(sizes, key=lambda x: (-x[0], x[1])):
        if held + sizes[at] > bound:
            break
        held += sizes[at]
        last = at
    if last is None:
        return {}, counts
    chosen = (level > last[0]) | ((level == last[0]) & (within <= last[1]))
    return {r["token"]: r["n"] for r in counts.where(chosen).collect()}, counts.where(~chosen)


def score(docs: DataFrame, train: Column, vocabulary: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    train is a condition on the rows that are learned from; held_out is its negation.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~train).alias("held_out"))
    counts = stored(token_counts(rows.where(~F.col("held_out"))), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    weights = estimate(counts, path)
    frequent, others = _head(counts, head)
    lattice = Lattice(path, weights)
    known = spark.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): (math.log10(n + 1), lattice.forward(t) if t else 0.0) for t, n in frequent.items()})
    shared = spark.sparkContext.broadcast(weights)
    ended = next((r["n"] for r in counts.where(F.col("token") == END).collect()), 0)
    end = lattice.logs[lattice.end]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in batches:
            out, rare, times, offsets = [[] for _ in range(4)], [], [], [0]
            for text in batch.column("text"):
                words = tokens(text.as_py())
                base, model, n_known = math.log10(ended + 1), end, int(ended > 0)
                for word, k in Counter(words).items():
                    found = own.get(word)
                    if found is None:
                        rare.append(word)
                        times.append(k)
                    else:
                        base += k * found[0]
                        model += k * found[1]
                        n_known += k
                offsets.append(len(rare))
                for column, value in zip(out, (len(words) + 1, n_known, base, model), strict=True):
                    column.append(value)
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["token", "k"])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, out, kinds), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rest"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rest array<struct<token:string,k:bigint>>"
    scored = stored(rows.mapInArrow(first_pass, schema).withColumn("row", F.monotonically_increasing_id()), "scored")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, shared.value)
        for batch in batches:
            coded = batch.column("token").dictionary_encode()
            chances = pa.array([lattice.forward(t) for t in coded.dictionary.to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "k", "n")), chances.take(coded.indices)], names=["row", "k", "n", "chance"])

    rare = scored.select("row", F.explode("rest").alias("rest")).select("row", "rest.token", "rest.k")
    matched = rare.join(others, "token", "left").select("row", "token", "k", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    k, n = F.col("k"), F.col("n")
    summed = matched.mapInArrow(second_pass, "row long, k long, n long, chance double").groupBy("row").agg(
        F.sum(k * F.log10(n + 1)).alias("rest_base"), F.sum(k * F.col("chance")).alias("rest_model"), F.sum(F.when(n > 0, k).otherwise(0)).alias("rest_known")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("rest").join(summed, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("rest_known")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rest_base") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        ((F.col("model") + zero("rest_model")) / F.lit(math.log(10))).alias("score"),
    )


def op4_scoring(docs: DataFrame) -> DataFrame:
    return score(docs, remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
