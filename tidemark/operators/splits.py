"""Client splits by hash: lockbox, repeated folds, development sets and stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import FOLDS
from tidemark.functions.hashing import fold_of, is_lockbox, uniform

#: Bins of a label's hashes, each of which one task orders.
BINS = 4096


def folds(people: DataFrame, seeds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """client_id, lockbox and fold_<seed>."""
    return people.select("client_id", is_lockbox(F.col("client_id")).alias("lockbox"), *(fold_of(s, F.col("client_id")).alias(f"fold_{s}") for s in seeds))


def development(people: DataFrame) -> DataFrame:
    """Clients of train and valid with is_valid and part: valid clients of the lockbox are `lockbox`, all others `development`."""
    locked = (F.col("split") == "valid") & is_lockbox(F.col("client_id"))
    rows = people.where(F.col("split").isin("train", "valid"))
    return rows.select("client_id", "label", (F.col("split") == "valid").alias("is_valid"), F.when(locked, "lockbox").otherwise("development").alias("part"))


def stratified(people: DataFrame, seed: int = 0, k: int = FOLDS) -> DataFrame:
    """client_id, label, fold: the clients of a label in hash order are dealt to the folds in turn.

    Hashes fall into BINS bins; a client's place is that in its bin plus the sizes of the label's bins before.
    """
    draw = uniform(seed, F.col("client_id"), "fold")
    rows = people.select("client_id", "label", draw.alias("draw"), F.floor(draw * BINS).alias("bin"))
    before = Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("label", "bin").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    starts = starts.select(F.col("label").alias("of_label"), F.col("bin").alias("of_bin"), "start")
    placed = rows.join(F.broadcast(starts), F.col("label").eqNullSafe(F.col("of_label")) & (F.col("bin") == F.col("of_bin")))
    order = Window.partitionBy("label", "bin").orderBy("draw", "client_id")
    return placed.select("client_id", "label", ((F.col("start") + F.row_number().over(order) - 1) % k).cast("int").alias("fold"))


def fold_violations(folds_found: DataFrame, people: DataFrame, seed: int) -> DataFrame:
    """One row: development clients without a fold, clients that are not of the development set, folds that differ from the hash."""
    dev = development(people).where("part = 'development'").select("client_id")
    both = folds_found.withColumn("f", F.lit(1)).join(dev.withColumn("d", F.lit(1)), "client_id", "full_outer")
    wrong = F.col("f").isNotNull() & (F.col("fold") != fold_of(seed, F.col("client_id")))
    return both.agg(F.count_if(F.col("f").isNull()).alias("n_missing"), F.count_if(F.col("d").isNull()).alias("n_extra"), F.count_if(wrong).alias("n_wrong"))
