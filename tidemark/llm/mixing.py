"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document of a source is due the same number of copies: the source's target over its size.
The whole part of it is allocated with certainty; for the rest, documents are ranked by the odds of
a uniform number over the odds of the fraction that is left (Pareto order sampling), and taken in
that order until the source's remaining words are reached, up to the nearest document.

The cut is found without ordering a source in one task: ranks fall into BINS bins by source, the bin
in which the words are reached is found from the bins' sums, is divided into BINS bins once more,
and only the documents of that inner bin are ordered. A document then compares its own rank with the
source's cut, so texts are never shuffled.

Defined results: a null text has size 0; a null source is a source of its own, last in order; equal
rows (same doc_id and text) share a rank, and as many of them as are due get the copy; sources
without words get target 0; an empty table gives an empty result; columns of docs are kept. Draws
depend on seed, doc_id and text alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

TOKEN = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating. Fixed values.
WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 1024
SEED = "mix"


def _source_key() -> Column:
    """Equal for equal sources, null among them, and never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """own (a row of docs), mix_key, source, mix_id, mix_size and mix_draw: 52 bits of the md5 of seed, doc_id and text."""
    named = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.select(
        F.struct(*(f"`{c}`" for c in docs.columns)).alias("own"),
        _source_key().alias("mix_key"),
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("mix_id"),
        F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("mix_size"),
        F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long").alias("mix_draw"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """mix_key, source_size, target: shares of all words by weight; what is above cap times a source's
    size goes to the others by weight. One row for each source.

    Sources reach their cap in order of size over weight, so one pass in that order finds the level
    at which the remaining sources share the remaining words.
    """
    per_source = sized.groupBy("mix_key").agg(F.min("source").alias("source"), F.sum("mix_size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    listed = per_source.withColumn("turn", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") + 1).cast("int")).cast("long"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = listed.withColumns({"place": F.row_number().over(order), "level": rest / weights_left})
    levelled = levelled.withColumn("capped", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    final = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("final") * F.col("weight"))
    return levelled.withColumn("final", final).select("mix_key", "source_size", target.alias("target"))


def _rank() -> Column:
    """Odds of the uniform number over the odds of the fraction due, mapped to [0, 1): x / (1 + x)."""
    u = (F.col("mix_draw") + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (F.col("fraction") / (1 - F.col("fraction")))
    return F.when(F.col("fraction") > 0, odds / (1 + odds)).otherwise(F.lit(1.0))


def _reached(sums: DataFrame, bin_name: str) -> DataFrame:
    """mix_key, the first bin at which the running sum of words comes to rest, and the rest within it."""
    running = Window.partitionBy("mix_key").orderBy(bin_name).rowsBetween(Window.unboundedPreceding, 0)
    summed = sums.withColumn("upto", F.sum("words").over(running)).where(F.col("upto") >= F.col("rest"))
    first = summed.groupBy("mix_key").agg(F.min(F.struct(bin_name, "upto", "words", "rest")).alias("at"))
    return first.select("mix_key", f"at.{bin_name}", (F.col("at.rest") - (F.col("at.upto") - F.col("at.words"))).alias("rest"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, bins: int = BINS) -> DataFrame:
    """One row for each source: mix_key, source_size, target, whole, fraction, and the cut: the last
    (rank, id, size) that is taken, how many rows equal it and how many of them are taken."""
    due = targets(sized, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    due = due.withColumns({"whole": F.floor(ratio).cast("long"), "fraction": ratio - F.floor(ratio)})
    due = stored(due.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "due")
    ranked = sized.select("mix_key", "mix_id", "mix_size", "mix_draw").join(due.where("fraction > 0 and rest > 0"), "mix_key")
    fine = F.least(F.floor(F.col("mix_rank") * (bins * bins)).cast("long"), F.lit(bins * bins - 1))
    ranked = ranked.withColumn("mix_rank", _rank()).withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / bins).cast("long"))
    coarse = _reached(ranked.groupBy("mix_key", "coarse").agg(F.sum("mix_size").alias("words"), F.min("rest").alias("rest")), "coarse")
    coarse = stored(coarse, "coarse")
    within = ranked.drop("rest").join(coarse, ["mix_key", "coarse"])
    at = _reached(within.groupBy("mix_key", "fine").agg(F.sum("mix_size").alias("words"), F.min("rest").alias("rest")), "fine")
    at = stored(at, "fine")
    last = ranked.drop("rest").join(at, ["mix_key", "fine"])
    row = F.struct("mix_rank", "mix_id", "mix_size")
    # equal rows are one row with their number, so very many of them are no work for one task
    equal = last.groupBy("mix_key", "mix_rank", "mix_id", "mix_size", "rest").agg(F.count("*").alias("equal"))
    before = Window.partitionBy("mix_key").orderBy("mix_rank", "mix_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum(F.col("mix_size") * F.col("equal")).over(before), F.lit(0))
    whole = F.least(F.greatest(F.floor(F.col("left") / F.col("mix_size")), F.lit(0)), F.col("equal"))
    over = (F.col("full") + 1) * F.col("mix_size") - F.col("left")
    nearer = (F.col("full") < F.col("equal")) & ((over <= 0) | (over < F.col("mix_size") - over))
    of_them = F.when(F.col("mix_size") == 0, F.when(F.col("left") >= 0, F.col("equal")).otherwise(F.lit(0))).otherwise(F.col("full") + nearer.cast("long"))
    equal = equal.withColumn("left", left).withColumn("full", F.when(F.col("mix_size") > 0, whole).otherwise(F.lit(0)).cast("long")).withColumn("of_them", of_them.cast("long"))
    cut = equal.where("of_them > 0").groupBy("mix_key").agg(F.max(F.struct(row.alias("row"), "equal", "of_them")).alias("cut"))
    # without a taken row in the inner bin, the cut lies at the bin's lower edge
    edge = F.struct((F.col("fine") / (bins * bins)).alias("mix_rank"), F.lit(None).cast("long").alias("mix_id"), F.lit(None).cast("long").alias("mix_size"))
    cuts = at.join(cut, "mix_key", "left").select("mix_key", F.coalesce("cut.row", edge).alias("row"), "cut.equal", "cut.of_them")
    return stored(due.join(cuts, "mix_key", "left"), "plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies added; own columns of these names are replaced."""
    sized = _sized(docs, seed)
    narrow = stored(sized.drop("own"), "sized")
    due = plan(narrow, weights, cap, bins)
    placed = sized.join(due, "mix_key").withColumn("mix_rank", _rank())
    row = F.struct("mix_rank", "mix_id", "mix_size")
    copies = lambda extra: F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")
    kept = [f"own.`{c}`" for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]
    result = lambda df, extra: df.select(
        *kept, "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies(extra).alias("mix_copies")
    )
    below = (F.col("fraction") > 0) & (row <= F.col("row"))
    if due.where("of_them < equal").isEmpty():
        return result(placed, below)
    tied = F.coalesce((row == F.col("row")) & (F.col("of_them") < F.col("equal")), F.lit(False))
    return result(placed.where(~tied), below).unionByName(result(_first(placed.where(tied)), F.col("place") <= F.col("of_them")))


def _first(tied: DataFrame) -> DataFrame:
    """Adds place: numbers the equal rows at each source's cut, partition by partition, as one may have very many."""
    parts = stored(tied.withColumn("part", F.spark_partition_id()), "tied")
    before = Window.partitionBy("mix_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("mix_key", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("mix_key", "part").orderBy(F.lit(0))
    return parts.withColumn("place", F.row_number().over(within)).join(counts, ["mix_key", "part"]).withColumn("place", F.col("place") + F.col("start"))


def op5_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the number of the copy."""
    kept = [f"`{c}`" for c in docs.columns if c not in ("copy", "mix_size", "mix_source_size", "mix_target", "mix_copies")]
    return mix(docs).where("mix_copies > 0").select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, row_number() OVER o AS place,
         CAST(CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT first(level ORDER BY place) AS level FROM l WHERE NOT level * weight >= 3 * source_size),
t AS (
  SELECT l.source, l.source_size, CASE WHEN l.level * weight >= 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE f.level * weight END AS target
  FROM l LEFT JOIN f ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t),
p AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS fraction, target - floor(ratio) * source_size AS rest FROM r),
k AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.fraction, p.rest, (draw + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
q AS (SELECT *, CASE WHEN fraction > 0 THEN (u / (1 - u)) / (fraction / (1 - fraction)) END AS odds FROM k),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN fraction > 0 AND rest > 0 AND (upto <= rest OR upto - rest < size - (upto - rest)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
