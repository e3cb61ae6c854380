"""Plumbing shared by the operators of this subpackage: table access, shared storage, hash folds
and hashed character n-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import stored

__all__ = ["bounded_sample", "draw", "gram_buckets", "labelled_sample", "packed_counts", "remainder", "sigmoid", "stored", "table", "text_counts", "word_buckets"]

#: Characters of a text handled at once; the rest follows in further pieces that overlap by a gram.
PIECE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


def draw(*columns: Column) -> Column:
    """A reproducible uniform number in [0, 1) from the columns' values."""
    return F.pmod(F.xxhash64(F.lit("draw"), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def quotas(sizes: list[int], bound: int) -> list[int]:
    """Rows of each group, at most `bound` in all: small groups whole, the others the same number each."""
    left, out = bound, [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    for done, i in enumerate(order):
        out[i] = min(sizes[i], left // (len(sizes) - done))
        left -= out[i]
    return out


def bounded_sample(rows: DataFrame, group: str, bound: int, *key: Column) -> DataFrame:
    """At most `bound` rows in all, shared evenly by the non-null values of `group`, by hash of `key`.

    Groups smaller than an even share are kept whole and leave the rest of it to the others; with more
    groups than `bound`, the `bound` largest have a row each. Counting is a full pass. A hash thins each
    group to a little more than its quota, so that only about 2 * bound rows are numbered and cut, group
    by group; of rows with equal keys as many as fit are kept. Quotas come by a join, so groups may be many.
    """
    spark, at = rows.sparkSession, dict(rows.dtypes)[group]
    number = draw(*key)
    counted = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.min(number).alias("least"))
    counts = counted.orderBy(F.desc("n"), group).limit(bound).collect()
    shares = quotas([r["n"] for r in counts], bound)
    # a group's quota is below the thinned rows but for a chance of about 1e-12; its least number is always in
    listed = [(r[group], q, max(min(1.0, (2 * q + 40) / r["n"]), r["least"])) for r, q in zip(counts, shares, strict=True) if q]
    wanted = spark.createDataFrame(listed, f"sample_group {at}, sample_quota int, sample_rate double")
    thinned = rows.join(F.broadcast(wanted), F.col(group) == F.col("sample_group")).withColumn("sample_number", number)
    order = Window.partitionBy("sample_group").orderBy("sample_number", *key)
    placed = thinned.where("sample_number <= sample_rate").withColumn("sample_place", F.row_number().over(order))
    # the plain limit lets Spark cut every partition before the shuffle
    return placed.where((F.col("sample_place") <= bound) & (F.col("sample_place") <= F.col("sample_quota"))).drop("sample_group", "sample_quota", "sample_rate", "sample_number", "sample_place")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text, label of at most `bound` rows of docs with a text and a label, shared evenly by the labels.

    A bounded sample of the labels is joined to docs, and the joined rows, of which an id may have many,
    are cut to the bound once more.
    """
    chosen = bounded_sample(labels, label, bound, F.col("doc_id"))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return bounded_sample(rows, label, bound, F.col("doc_id"), F.xxhash64("text"))


def gram_buckets(text: str, sizes: tuple[int, ...], bits: int):
    """Hash buckets of all character n-grams of the lower-cased text, one array for each piece and size.

    Pieces overlap by n - 1 characters, so no gram of a long text is lost or counted twice.
    """
    text = text.lower()
    for start in range(0, max(len(text), 1), PIECE):
        codes = np.frombuffer(text[start : start + PIECE + max(sizes) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        rolling = np.zeros(len(codes), np.uint32)
        for n in range(1, max(sizes) + 1):
            if len(codes) < n:
                break
            rolling = (rolling[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
            rolling ^= rolling >> np.uint32(15)
            if n in sizes:
                grams = rolling[:PIECE]
                yield ((grams + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def word_buckets(text: str, bits: int) -> np.ndarray:
    """Hash buckets of the lower-cased, white-space separated words and of their pairs."""
    found = np.array([zlib.crc32(w) for w in text.lower().encode("utf-8", "surrogatepass").split()], np.uint32)
    pairs = (found[:-1] * np.uint32(0x9E3779B1) ^ found[1:]) * np.uint32(0x85EBCA6B)
    return np.concatenate([found, pairs]) >> np.uint32(32 - bits)


def text_counts(text: str | None, sizes: tuple[int, ...], bits: int, word_bits: int = 0) -> np.ndarray:
    """Counts by bucket of the character n-grams and, in further buckets behind them, of the words."""
    counts = np.zeros((1 << bits) + (1 << word_bits if word_bits else 0), np.float32)
    for buckets in gram_buckets(text or "", sizes, bits):
        counts[: 1 << bits] += np.bincount(buckets, minlength=1 << bits)
    if word_bits:
        counts[1 << bits :] += np.bincount(word_buckets(text or "", word_bits), minlength=1 << word_bits)
    return counts


def packed_counts(rows: DataFrame, label: str, sizes: tuple[int, ...], bits: int, words: int = 0) -> list[tuple]:
    """(label, buckets, counts) of each row's text, for a bounded set of rows; the texts stay on the executors.

    A row takes at most 6 bytes for each bucket, whatever the length of its text.
    """

    def run(batches):
        for batch in batches:
            found = [text_counts(t.as_py(), sizes, bits, words) for t in batch.column("text")]
            at = [np.flatnonzero(c) for c in found]
            packed = [a.astype(np.uint16).tobytes() for a in at], [c[a].astype(np.float32).tobytes() for c, a in zip(found, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(label), *(pa.array(p, pa.binary()) for p in packed)], names=[label, "at", "n"])

    kind = dict(rows.dtypes)[label]
    packed = rows.select(label, "text").mapInArrow(run, f"{label} {kind}, at binary, n binary").collect()
    return [(r[label], np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.float32)) for r in packed]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
