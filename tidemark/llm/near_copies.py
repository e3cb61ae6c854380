"""Near copies by long SimHash fingerprints: multi-index hashing finds the pairs, complete distances and the
exact Jaccard similarity decide.

Two texts are near copies if the sets of their word 5-shingles have a Jaccard similarity of 0.8 or more;
components are taken over these pairs. A fingerprint has SEGMENTS * BITS bits, each the majority of a bit of
the shingles' hashes; sets of similarity J differ in a bit with a chance of acos(2J / (1 + J)) / pi, 0.15 at
J = 0.8 (sets of one size). Radii are those of multi-index hashing for a distance of SEGMENTS + WIDE - 1: balls of
radius 1 around each of the first WIDE segments, of radius 0 around the others. Fingerprints that differ in at
most 255 of the 6,272 bits always meet: else 32 segments had two bits or more apart and 192 one. Beyond, a pair at
exactly 0.8 meets with a chance of 0.99 (of equal segments alone, 0.90), at 0.85 with 0.9999; sets of a few shingles
meet less often. Two unrelated texts meet with a chance of 1.5e-5.

A ball is enumerated where its rows are: a row goes out for each half of a segment, and the bits of the other half are
flipped behind the exchange. Only bits that are 0 are flipped, so of two segments a bit apart the one finds the other.

Texts with one set of shingles are one node. Each node is first compared with one hub, of all nodes in its buckets the
one that meets others most often; a group's middle is that. Nodes that share a bucket with a node of another component
go on to a prefix filter (in small buckets, if that node is near): ordered by how rare they are, sets of similarity 0.8
share one of their first shingles, within bounds that their sizes give. Only such nodes are paired, so neither the copies
in one large group nor the texts at its edge, which are like no other, are compared with all of it.

Defined results: a null or wordless text has the empty set and is linked like any other; a text of fewer words
than a shingle is one shingle; rows are kept as often as they come; a null doc_id keeps its row, and never names
a component unless no other id is there; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.simhash import components, text_hash

SHINGLE = 5
#: Least similarity of near copies, as a fraction: whole numbers keep the comparison exact.
SIMILAR = (4, 5)
#: Segments of a fingerprint, and bits of each.
SEGMENTS, BITS = 224, 28
#: Segments with balls of radius 1; the others have balls of radius 0. Bits of a half of a segment.
WIDE, HALF = 32, BITS // 2
#: Words of 64 bits of which complete distances are taken, and the bits that may differ: at 0.8, 39 of 256 do on
#: average, with a deviation of 6; of unrelated texts 128 with a deviation of 8.
WORDS, DISTANCE = 4, 72
#: Bits of the whole fingerprint that may differ: at 0.8, 950 do on average with a deviation of 28, and 1,176 for
#: sets of 4 and 5 shingles.
WHOLE = 1400
#: Nodes of a bucket that are compared by distance before the prefix filter; of larger buckets all nodes go on.
FEW = 16
#: Shingles that go through the hash functions at once; their sums fit a byte.
BLOCK = 255


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 values (seed 42) of the text's word shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    spans = {b" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle, 0) + 1)} if words else ()
    return np.unique(np.array([xxhash.xxh64_intdigest(s, seed=42) for s in spans], np.uint64))


def long_fingerprint(found: np.ndarray, bits: int = SEGMENTS * BITS) -> np.ndarray:
    """The bits, each 0 or 1: whether it is set in over half of the shingles' hashes of its word."""
    salts = (np.arange(1, -(-bits // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    ones = np.zeros(64 * salts.shape[1], np.int64)
    for at in range(0, len(found), BLOCK):
        mixed = found[at : at + BLOCK, None] ^ salts
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return (2 * ones > len(found))[:bits]


def segments(bits: np.ndarray, width: int = BITS) -> np.ndarray:
    """(texts, segments): a key for each segment of fingerprints (texts, bits), its number and its bits."""
    own = bits.reshape(len(bits), -1, width) @ (np.int64(1) << np.arange(width, dtype=np.int64))
    return own + (np.arange(own.shape[1], dtype=np.int64) << width)


def _signed(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), seed=42) - (1 << 63)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, sizes, heads, prints = [], [], [], []
        for value in batch.column("text"):
            found = shingles(value.as_py())
            packed = np.packbits(long_fingerprint(found), bitorder="little")
            marks.append(_signed(found))
            sizes.append(len(found))
            heads.append(packed[: 8 * WORDS].view("<i8"))
            prints.append(packed.view("<i8"))
        columns = [pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], names=["doc_id", "text_hash", "mark", "size", "head", "print"])


def _segmented(batches: Iterator[pa.RecordBatch], part: slice) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("mark").to_numpy()
        for at in range(0, len(marks), 512):
            packed = batch.column("print").slice(at, 512).flatten().to_numpy().view(np.uint8).reshape(-1, SEGMENTS * BITS // 8)
            keys = segments(np.unpackbits(packed, axis=1, bitorder="little"))[:, part]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(marks[at : at + 512], keys.shape[1])), pa.array(keys.ravel())], names=["mark", "key"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([shingles(value.as_py()).view(np.int64) for value in batch.column("text")], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("print"), found], names=["mark", "print", "found"])


def _apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _near(a: Column, b: Column) -> Column:
    """Whether sizes and the first words of the fingerprints (structs of size and head) let the sets be similar."""
    least, of = SIMILAR
    return (a["size"] * of >= b["size"] * least) & (b["size"] * of >= a["size"] * least) & (_apart(a["head"], b["head"]) <= DISTANCE)


def _sets_of(marks: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """mark, print, found: the fingerprints and sets of the nodes."""
    asked = nodes.join(marks, "mark").select("mark", "print", F.col("first.text_hash").alias("text_hash"))
    # copies of a text are alike: one for each mark is enough
    texts = docs.select("text", text_hash(F.col("text")).alias("text_hash"))
    once = texts.join(asked, "text_hash").groupBy("mark").agg(F.min("text").alias("text"), F.first("print").alias("print"))
    return stored(once.mapInArrow(_sets, "mark long, print array<long>, found array<long>"), "sets")


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (low, high) of the nodes (x, y) whose sets are similar. Sizes and distances rule out most of the others."""
    least, of = SIMILAR
    told = nodes.select(F.struct("mark", "size", "head").alias("node"), F.col("mark").alias("own"))
    a, b = (told.select(F.col("node").alias(n), F.col("own").alias(m)) for n, m in (("a", "x"), ("b", "y")))
    pairs = pairs.join(a, "x").join(b, "y").where(_near(F.col("a"), F.col("b"))).select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))
    pairs = stored(pairs.distinct(), "pairs")
    sets = _sets_of(pairs.select(F.col("low").alias("mark")).unionByName(pairs.select(F.col("high").alias("mark"))).distinct(), nodes, docs)
    side = lambda name, at: sets.select(F.col("mark").alias(name), F.struct("print", "found").alias(at))
    both = pairs.join(side("low", "a"), "low").join(side("high", "b"), "high").where(_apart(F.col("a.print"), F.col("b.print")) <= WHOLE)
    # one pair at a time: a batch of pairs of long texts would be large
    common = F.size(F.array_intersect("a.found", "b.found"))
    return both.where(common * of >= (F.size("a.found") + F.size("b.found") - common) * least).select("low", "high")


def _within(rows: DataFrame, *bucket: str) -> DataFrame:
    """key, mark, n: the rows (mark, key) whose bucket has another node, and the nodes of the bucket."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*bucket))).where("n > 1").select("key", "mark", "n")


def balls(segmented: DataFrame) -> DataFrame:
    """mark, route, key: the rows (mark, key) of segments under every value that the ball of radius 1 around them reaches
    by setting a bit, and under their own.

    The bits of one half are set where the rows of a value of the other half are, so a row goes out twice, not 15 times.
    The key holds the half, as a value is reached within one of the two exchanges.
    """
    key, low = F.col("key"), F.lit((1 << HALF) - 1)
    number = F.shiftright("key", BITS)
    halves = ((F.shiftright("key", HALF), 0), (F.shiftleft(number, HALF).bitwiseOR(key.bitwiseAND(low)), HALF))
    routes = [F.struct(route.bitwiseOR(F.lit(half << 40)).alias("route"), F.lit(at).alias("at")) for half, (route, at) in enumerate(halves)]
    out = segmented.select("mark", "key", F.explode(F.array(*routes)).alias("r")).select("mark", "key", "r.route", "r.at").repartition("route")
    bit = lambda i: F.when(F.col("at") == 0, F.lit(1 << i)).otherwise(F.lit(1 << (HALF + i)))
    reached = [key, *(F.when(key.bitwiseAND(bit(i)) == 0, key.bitwiseOR(bit(i))) for i in range(HALF))]
    return out.select("mark", "route", "at", F.explode(F.array(*reached)).alias("key")).where("key is not null").select("mark", "route", key.bitwiseOR(F.when(F.col("at") == 0, F.lit(1 << 40)).otherwise(F.lit(1 << 41))).alias("key"))


def buckets(nodes: DataFrame) -> DataFrame:
    """key, mark, n: the nodes of every bucket with two or more, and their number."""
    prints = nodes.where("size > 0").select("mark", "print")
    of = lambda part: prints.mapInArrow(lambda batches: _segmented(batches, part), "mark long, key long")
    wide = stored(_within(balls(of(slice(WIDE))), "route", "key"), "wide")
    return wide.unionByName(stored(_within(of(slice(WIDE, None)), "key"), "equal"))


def _hubs(members: DataFrame) -> DataFrame:
    """x, y: each node of (mark, met, buckets) and, of all in its buckets, the one that meets others most often."""
    rows = members.select("mark", "met", F.explode("buckets.key").alias("key"))
    hub = F.max(F.struct("met", "mark")).over(Window.partitionBy("key"))
    return rows.withColumn("hub", hub).where(F.col("hub.mark") != F.col("mark")).groupBy(F.col("mark").alias("x")).agg(F.max("hub")["mark"].alias("y"))


def _open(members: DataFrame) -> DataFrame:
    """mark, root: the nodes of (mark, root, node, buckets) that share a bucket with one of another root; in a bucket of
    FEW nodes, only with one that is near."""
    rows = members.select("mark", "root", "node", F.explode("buckets").alias("bucket")).select("mark", "root", "node", "bucket.*")
    bucket = Window.partitionBy("key")
    around = F.collect_list(F.when(F.col("n") <= FEW, F.struct("root", "node"))).over(bucket)
    rows = rows.withColumns({"least": F.min("root").over(bucket), "most": F.max("root").over(bucket), "around": around}).where("least <> most")
    near = F.exists("around", lambda x: (x["root"] != F.col("root")) & _near(x["node"], F.col("node")))
    return rows.where((F.col("n") > FEW) | near).groupBy("mark").agg(F.first("root").alias("root"))


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """x, y: pairs of (mark, root, found) with different roots, all similar ones among them.

    With one order of shingles, rarest first, sets of a and b shingles with 9 * common >= 4 * (a + b), which is a
    similarity of 0.8, have their first common shingle at places i and j with 4 * b <= 5 * a - 9 * i and
    4 * a <= 5 * b - 9 * j. The least size and the greatest bound of a shingle tell first whether that can hold.
    """
    rows = sets.select("mark", "root", F.size("found").alias("size"), F.explode("found").alias("shingle"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("shingle")))
    place = F.row_number().over(Window.partitionBy("mark").orderBy("n", "shingle")) - 1
    rows = rows.withColumn("place", place).where("5 * place <= size").select("mark", "root", "size", "shingle", (5 * F.col("size") - 9 * F.col("place")).alias("bound"))
    own = Window.partitionBy("shingle")
    for _ in range(3):
        rows = rows.withColumns({"least": F.min("size").over(own), "most": F.max("bound").over(own), "low": F.min("root").over(own), "high": F.max("root").over(own)})
        rows = rows.where("low <> high and bound >= 4 * least and most >= 4 * size").select("mark", "root", "size", "shingle", "bound")
    rows = stored(rows, "prefixes")
    other = rows.select(F.col("mark").alias("y"), F.col("root").alias("other"), F.col("size").alias("other_size"), "shingle", F.col("bound").alias("other_bound"))
    met = rows.withColumnRenamed("mark", "x").join(other, "shingle").where("x < y and root <> other and bound >= 4 * other_size and other_bound >= 4 * size")
    return met.select("x", "y").distinct()


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs low < high of similar nodes whose components are those of all similar pairs that share a bucket."""
    members = buckets(nodes).groupBy("mark").agg(F.sum("n").alias("met"), F.collect_list(F.struct("key", "n")).alias("buckets"))
    members = stored(members, "members")
    near = stored(_alike(_hubs(members), nodes, docs), "near")
    found = stored(components(near), "components")
    told = nodes.select("mark", F.struct("size", "head").alias("node"))
    rooted = members.join(found.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark")).join(told, "mark")
    left = stored(_open(rooted), "open")
    pairs = prefix_pairs(_sets_of(left.select("mark"), nodes, docs).join(left, "mark"))
    return near.unionByName(stored(_alike(pairs, nodes, docs), "further"))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, mark, component_id, first_hash, as simhash.near_duplicates has them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).alias("text_hash"))
    rows = stored(rows.mapInArrow(_marked, "doc_id long, text_hash long, mark long, size int, head array<long>, print array<long>"), "shingles")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("text_hash").isNull().alias("no_text"), "text_hash"))
    nodes = stored(rows.groupBy("mark").agg(least.alias("first"), F.first("size").alias("size"), F.first("head").alias("head"), F.first("print").alias("print")), "nodes")
    groups = stored(components(links(nodes, docs)), "components")
    rooted = nodes.join(groups, nodes["mark"] == groups["node"], "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    by_mark = rooted.drop("first").join(named, "root").select("mark", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))
    return rows.drop("size", "head", "print").join(by_mark, "mark").select("doc_id", "text_hash", "mark", "component_id", "first_hash")
