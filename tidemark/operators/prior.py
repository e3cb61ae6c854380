"""Amount priors: histograms of typical amounts by family, learned from clean recurring streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.operators.streams import islands


def prior_streams(described: DataFrame) -> DataFrame:
    """client_id, sid, family, amount: streams of 3 or more payments (currencies together) that one family names clearly."""
    rows = described.where((F.col("type") == "card_payment") & F.col("kind").isin("fam", "generic_sub"))
    rows = islands(rows, ("client_id",))
    d = [F.col(f"d_{f}") for f in C.FAMILIES]
    sole = F.coalesce(*(F.when(x == 1.0, F.lit(f)) for f, x in zip(C.FAMILIES, d, strict=True)))
    streams = rows.withColumn("sole", sole).groupBy("client_id", "sid").agg(
        F.count("*").alias("n"),
        F.median("amount").alias("amount"),
        *(F.count_if(F.col("sole") == f).alias(f"k_{f}") for f in C.FAMILIES),
        *(F.min(F.when(F.col("sole") == f, F.struct("amount", "row_id"))).alias(f"first_{f}") for f in C.FAMILIES),
    )
    # most common family, ties to the one seen first in order of amount
    ranked = F.array(*(F.when(F.col(f"k_{f}") > 0, F.struct((-F.col(f"k_{f}")).alias("k"), F.col(f"first_{f}").alias("at"), F.lit(f).alias("family"))) for f in C.FAMILIES))
    best = streams.where("n >= 3").withColumn("best", F.array_min(F.filter(ranked, lambda x: x.isNotNull())))
    best = best.where((-F.col("best.k") >= 2) & (-F.col("best.k") >= 0.6 * F.col("n")))
    return best.select("client_id", "sid", "n", F.col("best.family").alias("family"), "amount")


def amount_prior(described: DataFrame) -> DataFrame:
    """family, bin, n, logp on the full grid of families and bins; amounts outside the grid are left out."""
    low, high = F.ln(F.lit(C.PRIOR_LOW)), F.ln(F.lit(C.PRIOR_HIGH))
    place = F.floor((F.ln("amount") - low) / ((high - low) / C.PRIOR_BINS))
    place = F.when(F.ln("amount") == high, F.lit(C.PRIOR_BINS - 1)).otherwise(place).cast("int")
    counts = prior_streams(described).withColumn("bin", place).where(F.col("bin").between(0, C.PRIOR_BINS - 1)).groupBy("family", "bin").agg(F.count("*").alias("n"))
    spark = described.sparkSession
    grid = spark.range(len(C.FAMILIES) * C.PRIOR_BINS).select(
        F.element_at(F.array(*map(F.lit, C.FAMILIES)), (F.col("id") / C.PRIOR_BINS).cast("int") + 1).alias("family"), (F.col("id") % C.PRIOR_BINS).cast("int").alias("bin")
    )
    full = grid.join(counts, ["family", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = full.groupBy("family").agg(F.sum(F.col("n") + 0.5).alias("total"))
    return full.join(totals, "family").select("family", "bin", "n", F.ln((F.col("n") + 0.5) / F.col("total")).alias("logp"))


def wide(prior: DataFrame) -> DataFrame:
    """bin and logp_<family>: 40 rows."""
    return prior.groupBy("bin").agg(*(F.max(F.when(F.col("family") == f, F.col("logp"))).alias(f"logp_{f}") for f in C.FAMILIES))
