"""Client, family and cross-family features from stream records, and their long, wide and candidate forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.operators.streams import amount_bin, main_currency

#: Columns of the primary stream in order; the last 19 are taken over under their own name.
CHURN = (
    "n30", "n60", "n90", "n180", "gap_last_ratio", "n_dup", "n_missed", "gap_regular", "amt_last_dev", "amt_max_absdev",
    "n_outlier", "swap_last1", "swap_last3", "generic_last1", "generic_last3", "fee_frac", "dom_std", "ref_after_last", "nref60",
)
PRIMARY = (
    "prob", "n", "last", "first", "span", "per", "gap_mad", "gap_last1", "gap_last2", "gap_last3", "gap_max", "skipped_cycle_frac",
    "amt", "amt_cv", "amt_trend", "amt_change_last", "nref", "ref_rate", "last_refunded", "last_ref", "odd_cur", "generic_frac",
    "mcc_top", "next", "overdue", "active", *CHURN,
)
NOISE_LEVEL = ("p_prob", "s_prob", "p_generic_frac", "p_mcc_top")
SEQUENCE = ("p_gap_last1", "p_gap_last2", "p_gap_last3", "p_gap_max", "p_skipped_cycle_frac", "p_amt_change_last")
#: Groups under trial, which the retained model leaves out. Fixed values.
TARGETED = ("earliest_plausible_next", "active_due_30_mass", "active_due_60_mass", "active_due_90_mass")
EXPERIMENTAL = SEQUENCE + TARGETED


def client_features(described: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each client: c_* of its transactions and streams."""
    t = described.join(main_currency(described), "client_id")
    refund, day = F.col("type") == "refund", F.col("day")
    sub = refund & F.col("kind").isin("fam", "generic_sub")
    rows = t.groupBy("client_id").agg(
        F.count("*").alias("c_rows"),
        *(F.count_if(F.col("type") == k).alias(f"c_n_{k}") for k in C.TYPES),
        F.count_if(sub).alias("c_sub_refunds"),
        F.count_if(refund & ~F.col("kind").isin("fam", "generic_sub")).alias("c_eve_refunds"),
        F.avg((F.col("fee") > 0).cast("double")).alias("c_fee_pos"),
        F.avg((F.col("currency") != F.col("main_currency")).cast("double")).alias("c_oddcur"),
        F.min("day").alias("c_first_day"),
        *(F.count_if(day > -w).alias(f"c_rows_{w}") for w in (30, 60, 90)),
        *(F.count_if(refund & (day > -w)).alias(f"c_refunds_{w}") for w in (30, 60, 90)),
        F.count_if(sub & (day >= -90)).alias("c_sub_ref_last90"),
        F.max(F.when(sub, day)).cast("double").alias("c_last_sub_ref"),
    )
    many, on = F.col("n") >= 2, F.col("active")
    upcoming = F.when(many & on, F.col("last") + F.col("per"))
    streams = records.groupBy("client_id").agg(
        F.count_if(many).alias("c_n_streams"),
        F.count_if(many & on).alias("c_n_active"),
        F.count_if(many & ~on).alias("c_n_ended"),
        F.count_if(many & on & (F.col("nref") > 0)).alias("c_n_active_ref"),
        F.count_if(many & ~on & (F.col("nref") > 0)).alias("c_n_ended_ref"),
        F.min(upcoming).alias("c_min_next"),
        F.count_if(upcoming.between(-7, 15)).alias("c_n_active_early"),
        F.count_if((F.col("n") == 1) & (F.col("last") >= -45) & (F.greatest(*(f"post_{f}" for f in C.FAMILIES)) > 0.5)).alias("c_n_recent_singles"),
        F.max(F.when(many & on, F.col("n"))).alias("c_max_act_n"),
        F.min(F.when(many & on, F.col("first"))).alias("c_min_act_first"),
        F.avg(F.when(many, (F.col("nref") > 0).cast("double"))).alias("c_frac_ref_streams"),
    )
    zeros = ("c_n_streams", "c_n_active", "c_n_ended", "c_n_active_ref", "c_n_ended_ref", "c_n_active_early", "c_n_recent_singles", "c_max_act_n", "c_min_act_first")
    return rows.join(streams, "client_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})


def by_family(records: DataFrame) -> DataFrame:
    """One row for each stream and family: family, family_id, post; ord orders a client's streams."""
    order = Window.partitionBy("client_id").orderBy("currency", "sid")
    listed = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(i).alias("family_id"), F.col(f"post_{f}").alias("post")) for i, f in enumerate(C.FAMILIES)))
    df = records.withColumn("ord", F.row_number().over(order)).withColumn("f", F.explode(listed))
    return df.drop(*(f"post_{f}" for f in C.FAMILIES)).select("*", "f.*").drop("f")


def _primary_columns() -> list[Column]:
    period = F.when(F.col("per") > 0, F.col("per")).otherwise(30.0)
    special = {
        "prob": F.col("post"), "per": period, "ref_rate": F.col("nref") / F.col("n"), "next": F.col("last") + period,
        "overdue": -F.col("last") / period, "active": F.col("active").cast("double"),
    }
    return [special.get(c, F.col(c)).cast("double").alias(f"p_{c}") for c in PRIMARY]


def family_features(records: DataFrame, prior: DataFrame) -> DataFrame:
    """One row for each (client, family) with a stream: soft counts, the primary stream p_*, the best single s_*.

    Both picks are conditional max_by aggregates, so the whole block is one aggregation.
    """
    long = by_family(records)
    likely = F.col("post") >= 0.15
    recurring, single = (F.col("n") >= 2) & likely, (F.col("n") == 1) & likely & (F.col("last") >= -62)
    on, post = recurring & F.col("active"), F.col("post")
    upcoming = F.col("last") + F.coalesce("per", F.lit(30))
    soft = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))
    best = F.struct(F.col("active").alias("a"), (post > 0.5).alias("b"), F.col("last").alias("c"), F.col("n").alias("d"), (-F.col("ord")).alias("e"))
    flat = F.struct(post.alias("s_prob"), F.col("last").cast("double").alias("s_last"), F.col("amt").alias("s_amt"))
    agg = long.groupBy("client_id", "family", "family_id").agg(
        soft(recurring, post * F.col("n90")).alias("n_events90"),
        soft(recurring, post * F.col("n180")).alias("n_events180"),
        soft(recurring, post).alias("n_streams"),
        soft(on, post).alias("n_active"),
        soft(recurring & ~F.col("active") & (F.col("nref") > 0), post).alias("n_ended_ref"),
        F.min(F.when(on, upcoming)).cast("double").alias("earliest_plausible_next"),
        *(soft(on & (upcoming <= w), post).alias(f"active_due_{w}_mass") for w in (30, 60, 90)),
        F.max_by(F.when(recurring, F.struct(*_primary_columns())), F.when(recurring, best)).alias("primary"),
        F.max_by(F.when(single, flat), F.when(single, F.struct(post.alias("a"), F.col("last").alias("b"), (-F.col("ord")).alias("c")))).alias("single"),
        F.count_if(single).alias("s_n"),
    )
    df = agg.select("*", *(F.col(f"primary.p_{c}") for c in PRIMARY), "single.s_prob", "single.s_last", "single.s_amt").drop("primary", "single")
    wanted = prior.select("family", "bin", F.col("logp").alias("s_amt_logp"))
    return df.withColumn("bin", amount_bin(F.col("s_amt"))).join(F.broadcast(wanted), ["family", "bin"], "left").drop("bin", "s_amt")


def cross_family(df: DataFrame) -> DataFrame:
    """Adds how each family's primary stream stands among the client's families with an active one.

    df has all seven families of a client, so the windows hold seven rows.
    """
    on = F.col("p_active") == 1
    client = Window.partitionBy("client_id")
    others = F.filter(F.col("listed"), lambda x: x["f"] != F.col("family_id"))
    df = df.withColumn("listed", F.collect_list(F.when(on, F.struct(F.col("family_id").alias("f"), F.col("p_next").alias("next"), F.col("p_n").alias("n"), F.col("p_last").alias("last")))).over(client))
    lesser = lambda part, own, sign: F.when(on, F.size(F.filter("listed", lambda x: sign * x[part] < sign * F.col(own))).cast("double"))
    return df.withColumns(
        {
            "n_other_active": F.size(others),
            "rel_next_minus_best_other": F.when(on, F.col("p_next") - F.array_min(F.transform(others, lambda x: x["next"]))),
            "next_rank": lesser("next", "p_next", 1),
            "n_rank": lesser("n", "p_n", -1),
            "last_rank": lesser("last", "p_last", -1),
        }
    ).drop("listed")


def build_features(described: DataFrame, records: DataFrame, prior: DataFrame) -> DataFrame:
    """One row for each client and each of the seven families."""
    clients = client_features(described, records)
    families = described.sparkSession.range(len(C.FAMILIES)).select(F.element_at(F.array(*map(F.lit, C.FAMILIES)), F.col("id").cast("int") + 1).alias("family"), F.col("id").cast("int").alias("family_id"))
    refunds = described.where("type = 'refund'").groupBy("client_id").agg(*(F.sum(f"d_{f}").alias(f"e_{f}") for f in C.FAMILIES))
    spine = clients.select("client_id").join(refunds, "client_id", "left").crossJoin(F.broadcast(families))
    own = F.coalesce(*(F.when(F.col("family") == f, F.col(f"e_{f}")) for f in C.FAMILIES), F.lit(0.0))
    spine = spine.withColumn("e_ref", own).select("client_id", "family", "family_id", "e_ref")
    blocks = family_features(records, prior).drop("family_id")
    df = spine.join(blocks, ["client_id", "family"], "left")
    soft = ("n_events90", "n_events180", "n_streams", "n_active", "n_ended_ref", "active_due_30_mass", "active_due_60_mass", "active_due_90_mass", "s_n")
    df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in soft})
    return cross_family(df).join(clients, "client_id")


def candidate_rows(features: DataFrame) -> DataFrame:
    """Eight rows for each client: its families and `none`, which has the c_* columns only; x_* sum up the client."""
    own = [c for c in features.columns if c.startswith("c_")]
    none = features.groupBy("client_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in own)).withColumns({"family": F.lit(C.NONE), "family_id": F.lit(len(C.FAMILIES))})
    summary = features.groupBy("client_id").agg(
        F.max("p_prob").alias("x_max_prob"),
        F.max("p_n").alias("x_max_n"),
        F.min("p_next").alias("x_min_next"),
        F.count_if(F.col("n_streams") > 0).cast("double").alias("x_n_fam"),
        F.max("n_active").alias("x_max_active"),
    )
    return features.unionByName(none, allowMissingColumns=True).join(summary, "client_id")


def wide_features(features: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row for each client: <family>__<column> of every column that is not c_*, and the c_* columns."""
    shared = [c for c in features.columns if c.startswith("c_") and c not in drop]
    own = [c for c in features.columns if c not in ("client_id", "family", "family_id", *shared, *drop)]
    picked = [F.max(F.when(F.col("family") == f, F.col(c))).alias(f"{f}__{c}") for f in C.FAMILIES for c in own]
    return features.groupBy("client_id").agg(*picked, *(F.first(c, ignorenulls=True).alias(c) for c in shared))


def feature_group(name: str) -> str:
    """Group of a feature by its name; the first match counts. Fixed values."""
    groups = (
        ("ordered_sequence", ("gap_last", "gap_max", "skipped_cycle", "amt_change_last")),
        ("refunds", ("ref", "refund")),
        ("timing", ("next", "last", "first", "span", "per", "overdue", "active", "due")),
        ("merchant_evidence", ("prob", "mcc", "generic", "amt", "family_id", "odd_cur")),
    )
    for group, parts in groups:
        if any(p in name for p in parts):
            return group
    return "background" if "c_" in name or "n_streams" in name else "other"
