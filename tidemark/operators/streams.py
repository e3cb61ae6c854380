"""Recurring payment streams: islands of similar amounts, their statistics, refunds and family posteriors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as C

KEY = ("client_id", "currency", "sid")


def islands(payments: DataFrame, by: tuple[str, ...] = ("client_id", "currency"), tolerance: float = C.TOLERANCE) -> DataFrame:
    """Adds sid: single-linkage clusters of ln(amount) within `by`, numbered from 0 by rising amount."""
    order = Window.partitionBy(*by).orderBy("amount", "row_id")
    step = F.ln("amount") - F.lag(F.ln("amount")).over(order)
    return payments.withColumn("step", step).withColumn("sid", F.sum(F.when(F.col("step") > tolerance, 1).otherwise(0)).over(order)).drop("step")


def candidates(described: DataFrame) -> DataFrame:
    return described.where((F.col("type") == "card_payment") & F.col("kind").isin(*C.SUBSCRIPTION_KINDS))


def main_currency(transactions: DataFrame) -> DataFrame:
    """client_id, main_currency: the most frequent, ties to the smaller name."""
    counted = transactions.groupBy("client_id", "currency").agg(F.count("*").alias("n"))
    return counted.groupBy("client_id").agg(F.min_by("currency", F.struct(-F.col("n"), "currency")).alias("main_currency"))


def stream_rows(payments: DataFrame) -> DataFrame:
    """Islands with each row's gap, place from the end and the medians of its stream.

    Every window and the later aggregates are partitioned by the client first, so one exchange serves all.
    """
    rows = islands(payments.repartition("client_id"))
    order, whole = Window.partitionBy(*KEY).orderBy("day", "timestamp", "row_id"), Window.partitionBy(*KEY)
    back = Window.partitionBy(*KEY).orderBy(F.desc("day"), F.desc("timestamp"), F.desc("row_id"))
    rows = rows.withColumns({"la": F.ln("amount"), "gap": F.col("day") - F.lag("day").over(order), "back": F.row_number().over(back)})
    rows = rows.withColumn("mcc_n", F.count("*").over(Window.partitionBy(*KEY, "mcc")))
    return rows.withColumns(
        {
            "per": F.median("gap").over(whole),
            "amt": F.median("amount").over(whole),
            "lam": F.median("la").over(whole),
            "mcc_main": F.min(F.struct(-F.col("mcc_n"), "mcc")).over(whole)["mcc"],
        }
    )


def refund_matches(rows: DataFrame, refunds: DataFrame, band: float = 0.03, days: int = 10) -> DataFrame:
    """Stream key and the refund rows that match it: near its median amount, 0 to 10 days after one of its payments."""
    r = refunds.select("client_id", "currency", F.col("row_id").alias("refund_id"), F.col("day").alias("refund_day"), F.col("amount").alias("refund_amount"), *(F.col(f"d_{f}").alias(f"r_{f}") for f in C.FAMILIES if f"d_{f}" in refunds.columns))
    # streams, which are few, meet the refunds in their band; a factor of 1 + band is less than a step and a half
    step = 1.5 * math.log1p(band)
    level = lambda c: F.floor(F.ln(c) / step).cast("long")
    own = rows.groupBy(*KEY).agg(F.first("amt").alias("amt")).withColumn("level", level("amt"))
    around = r.withColumn("level", F.explode(F.array(*(level("refund_amount") + i for i in (-1, 0, 1)))))
    met = own.join(around, ["client_id", "currency", "level"]).where(F.abs(F.col("refund_amount") / F.col("amt") - 1) < band).drop("amt", "level")
    # the days before a refund, each of which can be a payment's
    asked = met.withColumn("day", F.explode(F.sequence(F.col("refund_day") - days, F.col("refund_day"))))
    paid = rows.select(*KEY, "day").distinct()
    return asked.join(paid, [*KEY, "day"], "left_semi").drop("day").dropDuplicates([*KEY, "refund_id"])


def _last(value: str | Column, place: int) -> Column:
    return F.max(F.when(F.col("back") == place, F.col(value) if isinstance(value, str) else value))


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _log_share(weight: Column, epsilon: float) -> Column:
    return F.ln((1 - epsilon) * weight + epsilon / len(C.FAMILIES))


def _informative(prefix: str) -> Column:
    return sum((F.col(f"{prefix}_{f}") for f in C.FAMILIES[1:]), F.col(f"{prefix}_{C.FAMILIES[0]}")) > 0


def stream_summary(rows: DataFrame) -> DataFrame:
    """One row for each stream with its counts, gaps, amounts and summed family log-likelihoods ll_<family>."""
    gap, per, la = F.col("gap"), F.col("per"), F.col("la")
    first_amount = F.min_by("amount", F.struct("day", "timestamp", "row_id"))
    swapped, generic = (F.col("mcc") != F.col("mcc_main")).cast("double"), (F.col("kind") == "generic_sub").cast("double")
    regular = F.when(per > 0, (F.abs(gap / F.nullif(per, F.lit(0)) - 1) < 0.2).cast("double"))
    many = F.col("n") >= 2
    agg = rows.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.min("day").alias("first"),
        F.max("day").alias("last"),
        F.first("per").alias("per"),
        F.first("amt").alias("amt"),
        F.first("lam").alias("lam"),
        *(_count(F.col("day") > -w).alias(f"n{w}") for w in (30, 60, 90, 180)),
        *(_last("gap", i).alias(f"gap_last{i}") for i in (1, 2, 3)),
        F.max("gap").alias("gap_max"),
        _count(gap < 5).alias("n_dup"),
        _count((gap > 1.6 * per) & (per > 0)).alias("n_missed"),
        F.avg(regular).alias("gap_regular"),
        F.avg(F.when(per > 0, (gap > 1.5 * per).cast("double"))).alias("skipped_cycle_frac"),
        F.median(F.abs(gap - per)).alias("gap_mad_any"),
        _last("la", 1).alias("la_last"),
        F.max(F.abs(la - F.col("lam"))).alias("amt_max_absdev"),
        _count(F.abs(la - F.col("lam")) > 0.03).alias("n_outlier"),
        F.max(F.when(F.col("back") == 1, swapped)).alias("swap_last1"),
        F.sum(F.when(F.col("back") <= 3, swapped)).alias("swap_last3"),
        F.max(F.when(F.col("back") == 1, generic)).alias("generic_last1"),
        F.sum(F.when(F.col("back") <= 3, generic)).alias("generic_last3"),
        F.avg(generic).alias("generic_frac"),
        F.avg((F.col("fee") > 0).cast("double")).alias("fee_frac"),
        F.stddev_pop(F.dayofmonth("date").cast("double")).alias("dom_std_any"),
        F.stddev_samp("amount").alias("amount_std"),
        F.avg("amount").alias("amount_mean"),
        _last("amount", 1).alias("amount_last"),
        _last("amount", 2).alias("amount_before"),
        first_amount.alias("amount_first"),
        (F.max("mcc_n") / F.count("*")).alias("mcc_top"),
        *((F.sum(F.when(_informative("d"), _log_share(F.col(f"d_{f}"), C.EPSILON_DESCRIPTION)).otherwise(0.0)) + F.sum(F.ln((1 - C.MCC_NOISE) * (F.col("mcc") == C.FAMILY_MCC[f]).cast("double") + C.MCC_NOISE / 10))).alias(f"ll_{f}") for f in C.FAMILIES),
    )
    return agg.select(
        *KEY, "n", "first", "last", (F.col("last") - F.col("first")).alias("span"), "per", "amt", "n30", "n60", "n90", "n180",
        "gap_last1", "gap_last2", "gap_last3", "gap_max", "n_dup", "n_missed", "gap_regular", "skipped_cycle_frac",
        F.when(F.col("n") >= 3, F.col("gap_mad_any")).alias("gap_mad"),
        F.when(per > 0, F.col("gap_last1") / F.nullif(per, F.lit(0))).alias("gap_last_ratio"),
        (F.col("la_last") - F.col("lam")).alias("amt_last_dev"), "amt_max_absdev", "n_outlier",
        "swap_last1", "swap_last3", "generic_last1", "generic_last3", "generic_frac", "fee_frac",
        F.when(many, F.col("dom_std_any")).alias("dom_std"),
        F.when(many, F.col("amount_std") / F.col("amount_mean")).otherwise(0.0).alias("amt_cv"),
        F.when(many, F.col("amount_last") / F.col("amount_first")).otherwise(1.0).alias("amt_trend"),
        (F.col("amount_last") / F.col("amount_before") - 1).alias("amt_change_last"),
        "mcc_top", *(f"ll_{f}" for f in C.FAMILIES),
    )


def active(last: str = "last", per: str = "per") -> Column:
    return F.col(last) + F.coalesce(F.col(per), F.lit(30)) >= -7


def refund_summary(matches: DataFrame, summary: DataFrame) -> DataFrame:
    """Stream key with the counts of its matched refunds and what their descriptions add to ll_<family>."""
    day, last = F.col("refund_day"), F.col("last")
    return matches.join(summary.select(*KEY, "last"), list(KEY)).groupBy(*KEY).agg(
        F.count("*").alias("nref"),
        F.max(day).alias("last_ref"),
        F.max((day > last).cast("double")).alias("ref_after_last"),
        F.max((day - last).between(0, 10).cast("double")).alias("last_refunded"),
        _count(day > -60).alias("nref60"),
        *(F.sum(F.when(_informative("r"), _log_share(F.col(f"r_{f}"), C.EPSILON_REFUND)).otherwise(0.0)).alias(f"rl_{f}") for f in C.FAMILIES),
    )


def amount_bin(amount: Column) -> Column:
    """Bin of the look-up: (edge, next edge], clipped."""
    low, high = F.ln(F.lit(C.PRIOR_LOW)), F.ln(F.lit(C.PRIOR_HIGH))
    place = F.ceil((F.ln(amount) - low) / ((high - low) / C.PRIOR_BINS)) - 1
    return F.greatest(F.lit(0), F.least(F.lit(C.PRIOR_BINS - 1), place)).cast("int")


def stream_records(described: DataFrame, prior: DataFrame) -> DataFrame:
    """Every stream of every client with its statistics, refunds and post_<family>. prior: as prior.wide gives it."""
    rows = stream_rows(candidates(described))
    summary = stream_summary(rows)
    refunds = refund_summary(refund_matches(rows, described.where("type = 'refund'")), summary)
    df = summary.join(refunds, list(KEY), "left").join(main_currency(described), "client_id")
    df = df.withColumn("bin", amount_bin(F.col("amt"))).join(F.broadcast(prior), "bin", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumns({f"ll_{f}": F.col(f"ll_{f}") + F.col(f"logp_{f}") + zero(f"rl_{f}") for f in C.FAMILIES})
    df = df.withColumn("top", F.greatest(*(f"ll_{f}" for f in C.FAMILIES)))
    df = df.withColumns({f"e_{f}": F.exp(F.col(f"ll_{f}") - F.col("top")) for f in C.FAMILIES})
    total = sum((F.col(f"e_{f}") for f in C.FAMILIES[1:]), F.col(f"e_{C.FAMILIES[0]}"))
    df = df.withColumns({f"post_{f}": F.col(f"e_{f}") / total for f in C.FAMILIES})
    df = df.withColumns({"nref": F.coalesce("nref", F.lit(0)), "nref60": F.coalesce("nref60", F.lit(0)), "ref_after_last": zero("ref_after_last"), "last_refunded": zero("last_refunded"), "odd_cur": (F.col("currency") != F.col("main_currency")).cast("double"), "active": active()})
    return df.drop("bin", "top", "main_currency", *(f"{p}_{f}" for p in ("ll", "rl", "e", "logp") for f in C.FAMILIES))
