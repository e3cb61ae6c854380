"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are projected, shifted, quantised and put in order along several Hilbert curves. Along each
curve the rows are range-partitioned and numbered, and cut into blocks; a query is compared with the
rows of its own block and of the blocks within SHARE of the table on either side. The curves carry a code of
each vector, a byte for each component; the SPARE nearest by code of each block are merged, and the distances
of the original vectors in double precision rank them.

Equal vectors are one point of the curves, with a number of its own and the K + 1 smallest ids at it (a query
needs no more of them), so a vector that is repeated millions of times neither fills a block nor hides its
neighbours. `exact` compares the queries with all rows instead, in blocks; `recall` holds a search against it.

The searched share of a curve, not its number of rows, stays constant, so recall holds as the table
grows and the work for a query grows with the table. A block has BLOCK to MOST rows, so no task's does:
larger tables have more blocks on either side. Measured against brute force: see README.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, nor do rows with a null id; a query is compared with vectors of its own length only; equal
(id, vector) rows count once; an id with several vectors is several points, none of which is a
neighbour of a query with that id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

K = 10
CURVES = 16
#: Candidates that a block, and all blocks together, hand on for each query, in multiples of k + 1.
SPARE = 4
#: Dimensions of a projection, and bits of each, that a curve runs through.
DIMENSIONS, BITS = 8, 4
#: Share of the rows that is searched on either side of a query's block; rows of a block, at least and at most.
SHARE = 0.02
BLOCK, MOST = 1024, 8192
#: Queries that the exact comparison sends to all tasks at once.
ASKED = 2048
#: Vectors that are looked at to fit the scale of the projections, at most.
SCALE_ROWS = 4096


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of rows of non-negative cell numbers below 2 ** bits."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for q in [1 << b for b in range(bits - 1, 0, -1)]:  # undo the excess turns of each level
        for i in range(n):
            up = (x[:, i] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(up, q - 1, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        turn = np.where((x[:, n - 1] & q) != 0, turn ^ (q - 1), turn)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


class Curves:
    """Projections, shifts and scale of each curve for vectors of one length."""

    def __init__(self, sample: np.ndarray, length: int, curves: int, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = 1):
        rng, d = np.random.default_rng(seed + length), min(dimensions, length)
        self.bits = bits
        self.planes = [np.linalg.qr(rng.normal(size=(length, d)))[0] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 1, d) for _ in range(curves)]
        seen = [sample @ p for p in self.planes] if len(sample) else [np.zeros((1, d))] * curves
        self.middle, self.spread = [y.mean(0) for y in seen], [np.maximum(y.std(0), 1e-300) for y in seen]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        z = (vectors @ self.planes[curve] - self.middle[curve]) / self.spread[curve]
        even = 0.5 * (1 + np.tanh(0.8 * z))  # about uniform for a normal spread
        side = (1 << self.bits) - 1
        return hilbert_keys(np.clip((even * side + self.shifts[curve]).astype(np.int64), 0, side), self.bits)


def valid(embedding: Column) -> Column:
    """Whether the vector takes part."""
    inf = float("inf")
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part; -0.0 equals 0.0: x + 0.0 gives both the same bits."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))


def points(vectors: DataFrame, k: int = K) -> DataFrame:
    """point (a number of its own), first (its least id), embedding, ids (the k + 1 least, ascending) of each distinct vector.

    The numbers hold only within a written table.
    """
    # dense_rank keeps each repeated row of a kept id; a rank limit lets Spark cut every partition before the shuffle
    order = Window.partitionBy("embedding").orderBy("vec_id")
    least = _rows(vectors).withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1)
    found = least.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return found.select(F.monotonically_increasing_id().alias("point"), F.col("ids")[0].alias("first"), "embedding", "ids")


def coded(x: np.ndarray) -> list[bytes]:
    """Of each row its scale, as a double, and its components in units of it, a byte each."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    whole = np.rint(x / scale[:, None]).astype(np.int8)
    return [s.tobytes() + w.tobytes() for s, w in zip(scale, whole, strict=True)]


def decoded(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, :8].copy().view(np.float64) * raw[:, 8:].view(np.int8)


def _numbered(keyed: DataFrame, block: int) -> DataFrame:
    """Adds block: the number of the block of so many consecutive rows of a curve that the row is in.

    Rows are range-partitioned by curve, key and point; a row's number is its place in its partition
    plus the rows of the curve in the partitions before, whose counts (one row for each partition and
    curve) are all that the driver sees.
    """
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "curves")
    counts = sorted((r["curve"], r["part"], r["n"]) for r in ranged.groupBy("curve", "part").agg(F.count("*").alias("n")).collect())
    before, offsets = {}, []
    for curve, part, n in counts:
        offsets.append((curve, part, before.get(curve, 0)))
        before[curve] = before.get(curve, 0) + n
    starts = spark.createDataFrame(offsets, "curve int, part int, start long") if offsets else spark.createDataFrame([], "curve int, part int, start long")
    within = Window.partitionBy("curve", "part").orderBy("key", "point")
    placed = ranged.join(F.broadcast(starts), ["curve", "part"]).withColumn("at", F.row_number().over(within) - 1 + F.col("start"))
    return placed.withColumn("block", F.floor(F.col("at") / block).cast("long"))


def _nearest(square: np.ndarray, first: np.ndarray, keep: int) -> np.ndarray:
    """(queries, keep): columns of the least squares of each row, of equal ones those of the least ids."""
    keep = min(keep, square.shape[1])
    limit = np.partition(square, keep - 1, axis=1)[:, keep - 1]
    out = np.empty((len(square), keep), np.int64)
    for i, (own, at_most) in enumerate(zip(square, limit, strict=True)):
        some = np.flatnonzero(own <= at_most)
        out[i] = some[np.lexsort((first[some], own[some]))[:keep]]
    return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows of y, rows of x): squared distances, in single precision, so that rounding does not part ties."""
    return np.maximum((x * x).sum(1)[None] - 2 * y @ x.T + (y * y).sum(1)[:, None], 0).astype(np.float32)


def _best(k: int):
    """Of each curve and block: the nearest rows by code for every query that is compared with the block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, asked = group[~group.asks], group[group.asks]
        out = {"query": [], "point": [], "first": [], "square": []}
        for length in set(map(len, asked.code)) if len(own) else ():
            rows, queries = (g[[len(v) == length for v in g.code]] for g in (own, asked))
            if not len(rows):
                continue
            x, ids, first = decoded(rows.code.tolist()), rows.point.to_numpy(), rows["first"].to_numpy()
            for at in range(0, len(queries), 256):
                q = queries[at : at + 256]
                square = _squares(x, decoded(q.code.tolist()))
                near = _nearest(square, first, SPARE * (k + 1))
                out["query"].append(np.repeat(q.point.to_numpy(), near.shape[1]))
                out["point"].append(ids[near].ravel())
                out["first"].append(first[near].ravel())
                out["square"].append(np.take_along_axis(square, near, 1).ravel())
        whole = {"query": "int64", "point": "int64", "first": "int64", "square": "float32"}
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}).astype(whole)

    return run


def window(total: int, block: int = BLOCK) -> tuple[int, int]:
    """Rows of a block, and how many blocks on either side of its own a query is compared with."""
    beside = math.ceil(SHARE * total)
    block = max(block, min(beside, MOST))
    return block, max(1, math.ceil(beside / block))


def search(vectors: DataFrame, is_query: Column, k: int = K, curves: int = CURVES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector whose id meets is_query (a condition on vec_id) its
    k nearest found among the others, by Euclidean distance, ties to the smaller id."""
    spark = vectors.sparkSession
    known = stored(points(vectors, k), "points")
    total = known.count()
    block, beside = window(total, block)
    share = F.lit(min(1.0, SCALE_ROWS / max(total, 1)))
    sample = known.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * SCALE_ROWS).select("embedding").collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row["embedding"]), []).append(row["embedding"])
    seen = {length: np.array(rows) for length, rows in by_length.items()}

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted: dict[int, Curves] = {}
        for batch in batches:
            lengths = batch.embedding.map(len)
            for length, rows in batch.groupby(lengths):
                if length not in fitted:
                    fitted[length] = Curves(seen.get(length, np.zeros((0, length))), length, curves)
                x = np.stack(rows.embedding.to_numpy())
                rows = rows.assign(code=coded(x))
                for c in range(curves):
                    yield rows.assign(curve=np.int32(c), key=fitted[length].keys(x, c))[["curve", "key", "point", "first", "code"]]

    schema = "curve int, key long, point long, first long, code binary"
    placed = _numbered(known.select("point", "first", "embedding").mapInPandas(put, schema), block)
    queries = stored(_asked(vectors, is_query).join(known.select("point", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "point"), "queries")
    asked = placed.join(queries.select("point").distinct(), "point", "left_semi").withColumn("block", F.explode(F.sequence(F.col("block") - beside, F.col("block") + beside)))
    columns = ("curve", "block", "point", "first", "code")
    both = placed.select(*columns, F.lit(False).alias("asks")).unionByName(asked.select(*columns, F.lit(True).alias("asks")))
    found = both.groupBy("curve", "block").applyInPandas(_best(k), "query long, point long, first long, square float")
    top = Window.partitionBy("query").orderBy("square", "first", "point")
    pairs = found.groupBy("query", "point").agg(F.min("square").alias("square"), F.min("first").alias("first")).withColumn("place", F.row_number().over(top))
    return _ranked(pairs.where(F.col("place") <= SPARE * (k + 1)), queries, known, k)


def _asked(vectors: DataFrame, is_query: Column) -> DataFrame:
    return _rows(vectors.where(is_query)).distinct()


def _ranked(pairs: DataFrame, queries: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The k nearest of the candidate pairs (query, point), by the distances of the original vectors."""
    left = known.select(F.col("point").alias("query"), F.col("embedding").alias("a"))
    right = known.select("point", F.col("embedding").alias("b"), "ids")
    exact = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    scored = pairs.select("query", "point").join(right, "point").join(left, "query").select("query", exact.alias("score"), F.explode("ids").alias("vec_id"))
    answers = queries.withColumnRenamed("point", "query").join(scored, "query").where("vec_id <> query_id")
    nearest = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """As search, by comparing every query with all vectors: ASKED queries at a time are sent to all tasks, and
    each task hands on its nearest. Work grows with queries times rows."""
    known = stored(points(vectors, k), "points")
    queries = stored(_asked(vectors, is_query).join(known.select("point", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "point"), "queries")
    wanted = known.join(queries.select("point").distinct(), "point", "left_semi").select("point", "embedding")
    total = wanted.count()
    found, passes = None, max(1, math.ceil(total / ASKED))
    for part in range(passes):
        block = wanted.where(F.pmod(F.xxhash64("point"), F.lit(passes)) == part).collect()
        by_length: dict[int, list] = {}
        for r in block:
            by_length.setdefault(len(r["embedding"]), []).append((r["point"], r["embedding"]))

        def run(batches: Iterator[pd.DataFrame], by_length=by_length) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for length, rows in batch.groupby(batch.embedding.map(len)):
                    if length in by_length:
                        ids, first = rows.point.to_numpy(), rows["first"].to_numpy()
                        square = _squares(np.stack(rows.embedding.to_numpy()), np.array([e for _, e in by_length[length]]))
                        near = _nearest(square, first, SPARE * (k + 1))
                        asked = np.repeat([p for p, _ in by_length[length]], near.shape[1])
                        yield pd.DataFrame({"query": asked, "point": ids[near].ravel(), "first": first[near].ravel(), "square": np.take_along_axis(square, near, 1).ravel()})

        own = known.select("point", "first", "embedding").mapInPandas(run, "query long, point long, first long, square float")
        found = own if found is None else found.unionByName(own)
    top = Window.partitionBy("query").orderBy("square", "first", "point")
    return _ranked(found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= SPARE * (k + 1)), queries, known, k)


def recall(vectors: DataFrame, is_query: Column, k: int = K, **settings) -> float:
    """Share of the true k nearest of the queries that search finds; choose few queries."""
    same = ["query_id", "vec_id"]
    true = stored(exact(vectors, is_query, k).select(*same), "true")
    found = search(vectors, is_query, k, **settings).select(*same)
    return true.join(found, same, "left_semi").count() / max(true.count(), 1)


def op1_neighbours(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 100 == 0)
