"""Validation as counts of violations: one row for each table, and a check that raises on the first rule broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as C

COLUMNS = ("client_id", "timestamp", "amount", "currency", "direction", "type", "mcc", "description", "fee")
#: Rules in the order in which they are reported.
RULES = ("n_null", "n_empty_id", "n_bad_amount", "n_bad_fee", "n_bad_direction", "n_future")


class InvalidData(ValueError):
    """A table breaks a rule."""


def _finite(name: str):
    return ~F.isnan(name) & (F.abs(F.col(name)) < float("inf"))


def violations(df: DataFrame, cutoff: str, source: str = "transactions") -> DataFrame:
    """One row: how many rows break each rule. Missing values break only the rule on missing values."""
    missing = F.lit(False)
    for c in COLUMNS:
        missing = missing | F.col(c).isNull()
    return df.agg(
        F.lit(source).alias("source"),
        F.count("*").alias("n_rows"),
        F.count_if(missing).alias("n_null"),
        F.count_if(F.length("client_id") == 0).alias("n_empty_id"),
        F.count_if(~(_finite("amount") & (F.col("amount") > 0))).alias("n_bad_amount"),
        F.count_if(~(_finite("fee") & (F.col("fee") >= 0))).alias("n_bad_fee"),
        F.count_if(~F.col("direction").isin("in", "out")).alias("n_bad_direction"),
        F.count_if(F.col("timestamp") >= F.lit(cutoff).cast("timestamp")).alias("n_future"),
    )


def check_transactions(df: DataFrame, cutoff: str, source: str = "transactions") -> DataFrame:
    """df, if its columns are exactly COLUMNS and no row breaks a rule."""
    if set(df.columns) != set(COLUMNS):
        raise InvalidData(f"{source}: columns {sorted(set(df.columns) ^ set(COLUMNS))} are missing or not known")
    found = violations(df, cutoff, source).first()
    if not found["n_rows"]:
        raise InvalidData(f"{source}: no rows")
    for rule in RULES:
        if found[rule]:
            raise InvalidData(f"{source}: {rule} {found[rule]}")
    return df


def label_violations(labels: DataFrame, cutoff: str) -> DataFrame:
    """One row: missing values, repeated clients, other cutoffs, labels that are no class."""
    repeated = labels.groupBy("client_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_repeated"))
    rules = labels.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("client_id").isNull() | F.col("cutoff_date").isNull() | F.col("label").isNull()).alias("n_null"),
        F.count_if(F.col("cutoff_date") != cutoff).alias("n_bad_cutoff"),
        F.count_if(~F.col("label").isin(*C.CLASSES)).alias("n_bad_label"),
    )
    return rules.crossJoin(F.broadcast(repeated))


def split_overlaps(clients: DataFrame) -> DataFrame:
    """first, second, n_shared for each pair of splits of (split, client_id); 0 where they are disjoint."""
    pairs = clients.select("split").distinct()
    grid = pairs.select(F.col("split").alias("first")).join(pairs.select(F.col("split").alias("second")), F.col("first") < F.col("second"))
    own = clients.select("split", "client_id").distinct()
    shared = own.select(F.col("split").alias("first"), "client_id").join(own.select(F.col("split").alias("second"), "client_id"), "client_id").where(F.col("first") < F.col("second"))
    counts = shared.groupBy("first", "second").agg(F.count("*").alias("n"))
    return grid.join(counts, ["first", "second"], "left").select("first", "second", F.coalesce("n", F.lit(0)).alias("n_shared"))


def key_mismatches(left: DataFrame, right: DataFrame, key: str = "client_id") -> DataFrame:
    """One row: keys on one side only, and repeated or missing keys of the right side."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    sides = both.agg(F.count_if(F.col("r").isNull()).alias("n_left_only"), F.count_if(F.col("l").isNull()).alias("n_right_only"))
    dup = right.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col(key).isNull()).alias("n_null"))
    return sides.crossJoin(F.broadcast(dup))


def candidate_violations(rows: DataFrame) -> DataFrame:
    """One row: clients that have not one candidate of each class, and candidates that are no class."""
    per_client = rows.groupBy("client_id").agg(F.count("*").alias("n"), F.countDistinct("family").alias("distinct"), F.count_if(~F.col("family").isin(*C.CLASSES)).alias("other"))
    whole = (F.col("n") == len(C.CLASSES)) & (F.col("distinct") == len(C.CLASSES))
    return per_client.agg(F.count("*").alias("n_clients"), F.count_if(~whole).alias("n_incomplete"), F.coalesce(F.sum("other"), F.lit(0)).cast("long").alias("n_bad_candidate"))


def check_candidates(rows: DataFrame) -> DataFrame:
    found = candidate_violations(rows).first()
    if found["n_incomplete"] or found["n_bad_candidate"]:
        raise InvalidData(f"candidates: {found['n_incomplete']} clients without one of each class, {found['n_bad_candidate']} of no class")
    return rows


def check_known(asked: DataFrame, known: DataFrame, key: str = "client_id") -> DataFrame:
    """asked, if every key in it is known."""
    unknown = asked.select(key).join(known.select(key), key, "left_anti").limit(5).collect()
    if unknown:
        raise InvalidData(f"not known: {sorted(r[key] for r in unknown)}")
    return asked


def submission_violations(submission: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: as key_mismatches, and predictions that are missing or no class."""
    column = "predicted_next_recurring_merchant"
    bad = submission.agg(F.count_if(F.col(column).isNull() | ~F.col(column).isin(*C.CLASSES)).alias("n_bad_label"))
    return key_mismatches(sample, submission).crossJoin(F.broadcast(bad))


def check_leak_contrast(leaky: float, safe: float, least_safe: float = 0.55, least_recovery: float = 0.15) -> None:
    if safe < least_safe:
        raise InvalidData(f"the safe model's score {safe:.3f} is below {least_safe:.3f}")
    if safe - leaky < least_recovery:
        raise InvalidData(f"the safe model recovers only {safe - leaky:.3f}, less than {least_recovery:.3f}")
