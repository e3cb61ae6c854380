"""Near-duplicate detection by SimHash and multi-index hashing.

A fingerprint sums up the word 3-shingles of a document. Two fingerprints that differ in at most 3
bits differ in at most 1 bit in one of their two halves, so every fingerprint probes the two tables
of halves with the ball of radius 1 around each half; matches are verified on all 64 bits.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; equal
texts share a fingerprint; rows are kept as often as they come; a null doc_id keeps its row, and
never names a component unless no other id is there (then component_id is null); an empty table
gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SHINGLE = 3
DISTANCE = 3
HALF = 32
#: Shingle hashes whose bits are summed at once.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=42)
    joined = b" ".join(words)
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends.tolist()
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(n, at + BLOCK)], ends[at + shingle - 1 :], strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], seed=42) for i, j in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << bit for bit in np.flatnonzero(2 * ones > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(value.as_py()) for value in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(marks)], names=["doc_id", "text_hash", "mark"])


def text_hash(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the raw text, null for null), mark: the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, mark long")


def _half(mark: Column, part: int) -> Column:
    mask = F.lit((1 << HALF) - 1)
    return (F.shiftrightunsigned(mark, HALF) if part else mark).bitwiseAND(mask)


def links(marks: DataFrame) -> DataFrame:
    """Pairs low < high of distinct fingerprints at distance 1 to DISTANCE, each pair once.

    Of two halves one bit apart, the one with the 0 finds the other, so only zero bits are flipped.
    """
    m = F.col("mark")
    key = lambda part, value: F.shiftleft(F.lit(part).cast("long"), HALF).bitwiseOR(value)
    table = marks.select(m.alias("other"), F.explode(F.array(*[key(p, _half(m, p)) for p in (0, 1)])).alias("key"))
    flips = []
    for part in (0, 1):
        half = _half(m, part)
        flips += [key(part, half)] + [
            F.when(half.bitwiseAND(F.lit(1 << bit)) == 0, key(part, half.bitwiseOR(F.lit(1 << bit)))) for bit in range(HALF)
        ]
    probes = marks.select(m, F.explode(F.array(*flips)).alias("key")).where(F.col("key").isNotNull())
    met = probes.join(table, "key").where((F.col("mark") != F.col("other")) & (F.bit_count(F.col("mark").bitwiseXOR(F.col("other"))) <= DISTANCE))
    return met.select(F.least("mark", "other").alias("low"), F.greatest("mark", "other").alias("high")).distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable over the pairs (low, high), for every node that has a link.

    Alternates the large-star and small-star steps until no edge changes; each round ends in a
    written table, so lineage does not grow.
    """
    edges = stored(pairs.select(F.col("low").alias("u"), F.col("high").alias("v")), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u"))
        root = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(root, "u").select(F.col("m").alias("u"), "v").where("u <> v").unionByName(root.select(F.col("m").alias("u"), F.col("u").alias("v")))
        edges = stored(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, mark, component_id, first_hash.

    component_id is the smallest doc_id of the row's component. first_hash is the text_hash of the row
    that represents the component, the least by (doc_id, text_hash) with nulls last.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("text_hash").isNull().alias("no_text"), "text_hash"))
    marks = rows.groupBy("mark").agg(least.alias("first"))
    marks = stored(marks, "marks")
    groups = stored(components(links(marks.select("mark"))), "components")
    rooted = marks.join(groups, marks["mark"] == groups["node"], "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    by_mark = rooted.drop("first").join(named, "root").select("mark", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))
    return rows.join(by_mark, "mark").select("doc_id", "text_hash", "mark", "component_id", "first_hash")


def op6_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, components_of: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """Of each component the row that represents it, with docs' columns; of equal such rows the least by the other columns."""
    found = components_of(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("first_hash")))
    kept = stored(kept.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).agg(F.count("*").alias("copies")), "kept")
    own = text_hash(docs["text"])
    chosen = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & own.eqNullSafe(kept["kept_hash"]), "left_semi")
    if kept.where("copies > 1").isEmpty():
        return chosen
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")]
    order = Window.partitionBy("doc_id", own).orderBy(*(others or [F.lit(0)]))
    return chosen.withColumn("_kept_copy", F.row_number().over(order)).where("_kept_copy = 1").drop("_kept_copy")
