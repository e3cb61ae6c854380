"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are hashed to longs, K consecutive ones to a gram hash. Of every WIDTH consecutive gram hashes
the least is kept as a fingerprint, on both sides; a span of K + WIDTH - 1 = 10 shared words holds a
whole such window, so both sides keep the same fingerprint of it. Fingerprints are joined, and each
match is extended by comparing the word hashes of all windows of 10 words around it. Items of fewer
words than a window are matched as a whole, by the gram hash of their length.

Defined results: null or wordless texts have no words, are never hit and match nothing; rows of docs
are kept as often as they come, a null doc_id too; items of equal words count each by its item_id,
repeated rows of an item once, and an item without id can hit but is not listed; empty tables on
either side give no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SPAN = 10
K = 5
WIDTH = SPAN - K + 1
#: A word of the lower-cased text, found in the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark fingerprints up to this many are broadcast (about 200 bytes each); more are shuffled.
BROADCAST_ROWS = 200_000
#: Item ids at all of these fingerprints up to this many are broadcast with them (8 bytes each).
BROADCAST_IDS = 2_000_000
#: Keys of contaminated documents up to this many are broadcast to the filter; more are shuffled.
BROADCAST_KEYS = 1_000_000


def _lowered(word: Column) -> Column:
    """A-Z lowered, and no other letters. Words of bytes below 128 alone take the short way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _hashed(df: DataFrame) -> DataFrame:
    """Adds hw: the hashes of the words of column text."""
    words = F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    return df.withColumn("hw", F.transform(words, lambda w: F.xxhash64(_lowered(w))))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _shifted(left: Column, right: Column, by: int, combine) -> Column:
    """combine(left[i], right[i + by]) for every i that has both."""
    size = F.greatest(F.least(F.size(left), F.size(right) - by), F.lit(0))
    return _let(size, lambda n: F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(by + 1), n), combine))


def _grams(words: Column, length: int) -> Column:
    """Hashes of all runs of so many word hashes, by doubling."""
    mixed = lambda a, b: F.xxhash64(a, b)
    if length == 1:
        return words
    if length % 2:
        return _let(_grams(words, length - 1), lambda g: _shifted(g, words, length - 1, mixed))
    return _let(_grams(words, length // 2), lambda g: _shifted(g, g, length // 2, mixed))


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _winnowed(grams: Column) -> Column:
    """The distinct least gram hashes of all windows of WIDTH = 6 grams."""
    pairs = lambda two: _let(_shifted(two, two, 2, _least), lambda four: _shifted(four, two, 4, _least))
    return F.array_distinct(_let(_shifted(grams, grams, 1, _least), pairs))


def _fingerprints(df: DataFrame) -> DataFrame:
    """Adds grams and prints: all gram hashes, and those that winnowing keeps."""
    marked = _let(F.col("hw"), lambda hw: _let(_grams(hw, K), lambda g: F.struct(g.alias("grams"), _winnowed(g).alias("prints"))))
    return df.withColumn("marked", marked).select(*df.columns, "marked.grams", "marked.prints")


def _positions(grams: str, value: str) -> Column:
    return F.filter(F.transform(F.col(grams), lambda g, i: F.when(g == F.col(value), i + 1)), lambda i: i.isNotNull())


def benchmark_prints(benchmark: DataFrame) -> DataFrame:
    """value, ctx, lead, ids: fingerprints of the items, each with the words around it that a window can
    reach, how many of them stand before the gram, and the ids of the items of these words."""
    items = _hashed(benchmark.select("item_id", "text")).where(F.size("hw") >= SPAN).groupBy("hw").agg(F.collect_set("item_id").alias("ids"))
    rows = _fingerprints(items).select("hw", "ids", "grams", F.explode_outer("prints").alias("value"))
    rows = rows.select("hw", "ids", "value", F.explode_outer(_positions("grams", "value")).alias("q"))
    lead = F.least(F.col("q") - 1, F.lit(WIDTH - 1))
    return rows.select("value", F.slice("hw", F.col("q") - lead, lead + SPAN).alias("ctx"), lead.alias("lead"), "ids").distinct()


def short_items(benchmark: DataFrame) -> DataFrame:
    """length, value, ctx, lead, ids as in benchmark_prints, of the items of 1 to SPAN - 1 words."""
    items = _hashed(benchmark.select("item_id", "text")).where(F.size("hw").between(1, SPAN - 1)).groupBy("hw").agg(F.collect_set("item_id").alias("ids"))
    return items.select(F.size("hw").alias("length"), _short_value(F.col("hw")).alias("value"), F.col("hw").alias("ctx"), F.lit(0).alias("lead"), "ids")


def _short_value(hw: Column) -> Column:
    """The gram hash of all of fewer than SPAN word hashes."""
    value = F.lit(None).cast("long")
    for n in range(1, SPAN):
        value = F.when(F.size(hw) == n, _grams(hw, n)[0]).otherwise(value)
    return value


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _met(rows: DataFrame, prints: str, grams: str, span: int, wanted: DataFrame) -> DataFrame:
    """doc_id, key, start, stop, ids: windows of span words of the documents that occur in an item. rows holds the
    fingerprints of a document in prints."""
    met = rows.select("doc_id", "key", "hw", grams, F.explode_outer(prints).alias("value")).join(wanted, "value")
    placed = met.select("doc_id", "key", "hw", "ctx", "lead", "ids", F.explode_outer(_positions(grams, "value")).alias("p"))
    placed = placed.select("*", F.explode_outer(F.sequence(-F.col("lead"), F.lit(0))).alias("o"))
    start, inside = F.col("p") + F.col("o"), F.col("lead") + F.col("o") + 1
    fits = (start >= 1) & (start + span - 1 <= F.size("hw")) & (inside + span - 1 <= F.size("ctx"))
    same = F.slice("hw", F.greatest(start, F.lit(1)), F.lit(span)) == F.slice("ctx", F.greatest(inside, F.lit(1)), F.lit(span))
    return placed.where(fits & same).select("doc_id", "key", start.alias("start"), (start + span - 1).alias("stop"), "ids")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key(F.col("text")).alias("key"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_words, prints of every row: the one pass that looks at all words."""
    rows = _fingerprints(_hashed(_texts(docs)).select("doc_id", "key", "hw"))
    return stored(rows.select("doc_id", "key", F.size("hw").cast("long").alias("n_words"), "prints"), "fingerprints")


def hits(docs: DataFrame, benchmark: DataFrame, marked: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, key, spans (sorted start, stop of the windows), items (distinct item ids) for documents with a hit.

    The fingerprints of all documents are met with those of the benchmark; only the documents that
    share one are read again, for the words around it.
    """
    marked = fingerprinted(docs) if marked is None else marked
    wanted = stored(benchmark_prints(benchmark), "prints")
    sized = sized_by_rows(wanted, broadcast_rows)
    shared = marked.select("key", F.explode_outer("prints").alias("value")).join(sized(wanted.select("value").distinct()), "value", "left_semi")
    shared = stored(shared.select("key").distinct(), "shared")
    few = shared.count() <= BROADCAST_KEYS
    rows = _hashed(_texts(docs).join(F.broadcast(shared) if few else shared, "key", "left_semi")).select("doc_id", "key", "hw")
    found = _met(_fingerprints(rows), "prints", "grams", SPAN, sized(wanted))
    short = stored(short_items(benchmark), "short")
    lengths = sorted(r["length"] for r in short.select("length").distinct().collect())
    if lengths:
        found = found.unionByName(_short_hits(docs, short, lengths, sized_by_rows(short, broadcast_rows)))
    return found.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items")
    )


def _short_hits(docs: DataFrame, short: DataFrame, lengths: list[int], sized) -> DataFrame:
    """As _met, for the items of fewer than SPAN words: one further pass over the documents for all lengths."""
    at = lambda n: F.transform(_grams(F.col("hw"), n), lambda g, i: F.struct(g.alias("value"), (i + 1).alias("start"), F.slice("hw", i + 1, F.lit(n)).alias("words")))
    runs = at(lengths[0])
    for n in lengths[1:]:
        runs = F.when(F.col("length") == n, at(n)).otherwise(runs)
    each = _hashed(_texts(docs)).select("doc_id", "key", "hw", F.explode(F.array(*map(F.lit, lengths))).alias("length"))
    each = each.select("doc_id", "key", "length", F.explode(runs).alias("run")).select("doc_id", "key", "length", "run.*")
    met = each.join(sized(short.select("length", "value", "ctx", "ids")), ["length", "value"]).where("words = ctx")
    return met.select("doc_id", "key", "start", (F.col("start") + F.col("length") - 1).alias("stop"), "ids")


def sized_by_rows(df: DataFrame, most: int):
    """Broadcasts a small side: df and what is selected from it, if it has few rows and few ids in all."""
    size = df.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    return F.broadcast if size[0] <= most and size[1] <= BROADCAST_IDS else lambda side: side


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, stop) spans."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        fresh = F.greatest(x["stop"] - F.greatest(acc["reach"], x["start"] - 1), F.lit(0))
        return F.struct(F.greatest(acc["reach"], x["stop"]).alias("reach"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, zero, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans and items as in hits (null without a hit)."""
    marked = fingerprinted(docs)
    counted = marked.select("doc_id", "key", "n_words")
    found = hits(docs, benchmark, marked).select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "spans", "items")
    same = counted["doc_id"].eqNullSafe(found["hit_id"]) & (counted["key"] == found["hit_key"])
    return counted.join(found, same, "left").select("doc_id", "n_words", "spans", "items")


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda i: i.cast("string")))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return decontaminate(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with docs' columns."""
    hit = stored(hits(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")), "hit")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_KEYS else hit
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["hit_id"]) & (_key(docs["text"]) == hit["hit_key"]), "left_anti")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{0080}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{0080}-\x{10FFFF}]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS span, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT uid, span, i, array_to_string(w[i : i + span - 1], ' ') AS gram
  FROM (SELECT uid, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, (SELECT DISTINCT span FROM bw) WHERE len(w) >= span)),
met AS (SELECT uid, i, span, item_id FROM dw JOIN bw USING (span, gram)),
hit AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + span)) AS p FROM met) GROUP BY uid),
items AS (
  SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN items USING (uid)
"""
