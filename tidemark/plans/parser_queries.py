"""Queries of the parser stack: scan, grammar, streams, prior, features, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.operators import features, grammar, prior, streams, validate
from tidemark.plans.oracle import sql
from tidemark.plans.registry import query, rounded, rounded_sql
from tidemark.sources import adapters
from tidemark.sources.storage import stored


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.described(adapters.transactions(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Described transactions, stream records and the amount prior, each written once: all three are read several times."""
    rows = stored(described(spark, sf_dir), "described")
    learned = stored(prior.amount_prior(rows), "prior")
    return rows, stored(streams.stream_records(rows, prior.wide(learned)), "records"), learned


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_features(*records(spark, sf_dir))


KEY = ("client_id", "currency", "sid")
COUNTS = ("n", "first", "last", "span", "n30", "n60", "n90", "n180")
GAPS = ("per", "gap_mad", "gap_last1", "gap_last2", "gap_last3", "gap_max", "gap_last_ratio", "n_dup", "n_missed", "gap_regular", "skipped_cycle_frac", "dom_std")
AMOUNTS = ("amt", "amt_cv", "amt_trend", "amt_change_last", "amt_last_dev", "amt_max_absdev", "n_outlier", "fee_frac", "mcc_top", "swap_last1", "swap_last3", "generic_last1", "generic_last3", "generic_frac")
POSTERIOR = ("nref", "nref60", "last_ref", "last_refunded", "ref_after_last", "odd_cur", *(f"post_{f}" for f in C.FAMILIES))
BLOCK = ("e_ref", "n_events90", "n_events180", "n_streams", "n_active", "n_ended_ref", "active_due_30_mass", "active_due_60_mass", "active_due_90_mass", "s_n", "earliest_plausible_next", *(f"p_{c}" for c in features.PRIMARY), "s_prob", "s_last", "s_amt_logp")
CROSS = ("n_other_active", "rel_next_minus_best_other", "next_rank", "n_rank", "last_rank")
CLIENT = (
    "c_rows", *(f"c_n_{t}" for t in C.TYPES), "c_sub_refunds", "c_eve_refunds", "c_fee_pos", "c_oddcur", "c_first_day", "c_n_streams", "c_n_active", "c_n_ended",
    "c_n_active_ref", "c_n_ended_ref", "c_min_next", "c_n_active_early", "c_n_recent_singles", "c_max_act_n", "c_min_act_first", "c_frac_ref_streams",
    *(f"c_{k}_{w}" for k in ("rows", "refunds") for w in (30, 60, 90)), "c_sub_ref_last90", "c_last_sub_ref",
)


@query(sql("""SELECT 'transactions' AS source, count(*) AS n_rows, count(*) FILTER (client_id IS NULL OR currency IS NULL OR type IS NULL OR mcc IS NULL OR description IS NULL OR amount IS NULL OR fee IS NULL OR timestamp IS NULL OR direction IS NULL) AS n_null,
count(*) FILTER (length(client_id) = 0) AS n_empty_id, count(*) FILTER (NOT amount > 0) AS n_bad_amount, count(*) FILTER (fee < 0) AS n_bad_fee, count(*) FILTER (direction NOT IN ('in', 'out')) AS n_bad_direction, count(*) FILTER (timestamp >= TIMESTAMP '2024-02-01') AS n_future FROM raw_txn"""))  # fmt: skip
def scan_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(adapters.raw_transactions(spark, sf_dir), adapters.CUTOFF)


@query(sql("SELECT description, array_to_string(bases, '|') AS bases, stripped, exact FROM parsed"))
def parse_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grammar.parse(adapters.transactions(spark, sf_dir).select("description").distinct())
    return found.withColumn("bases", F.array_join("bases", "|"))


@query(sql(rounded_sql("ev", ("description", "kind"), [f"d_{f}" for f in C.FAMILIES])))
def evidence_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grammar.evidence(grammar.parse(adapters.transactions(spark, sf_dir).select("description").distinct()))
    return rounded(found, ("description", "kind"), [f"d_{f}" for f in C.FAMILIES])


@query(sql("SELECT type, kind, count(*) AS n FROM de GROUP BY type, kind"))
def kind_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).groupBy("type", "kind").agg(F.count("*").alias("n"))


@query(sql("SELECT row_id, client_id, currency, sid FROM isl"))
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.islands(streams.candidates(described(spark, sf_dir))).select("row_id", "client_id", "currency", "sid")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stream_summary(streams.stream_rows(streams.candidates(described(spark, sf_dir))))


@query(sql(rounded_sql("summ", KEY, COUNTS)))
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir), KEY, COUNTS)


@query(sql(rounded_sql("summ", KEY, GAPS)))
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir), KEY, GAPS)


@query(sql(rounded_sql("summ", KEY, AMOUNTS)))
def stream_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir), KEY, AMOUNTS)


@query(sql("SELECT client_id, currency, sid, refund_id, refund_day FROM rmatch"))
def refund_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = described(spark, sf_dir)
    found = streams.refund_matches(streams.stream_rows(streams.candidates(rows)), rows.where("type = 'refund'"))
    return found.select(*KEY, "refund_id", "refund_day")


@query(sql(rounded_sql("prior", ("family", "bin"), ("n", "logp"))))
def amount_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prior.amount_prior(described(spark, sf_dir)), ("family", "bin"), ("n", "logp"))


@query(sql(rounded_sql("rec", (*KEY, "active"), POSTERIOR)))
def stream_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records(spark, sf_dir)[1], (*KEY, "active"), POSTERIOR)


@query(sql(rounded_sql("cfull", ("client_id",), CLIENT)))
def client_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found, _ = records(spark, sf_dir)
    return rounded(features.client_features(rows, found), ("client_id",), CLIENT)


@query(sql(rounded_sql("ff", ("client_id", "family", "family_id"), BLOCK)))
def family_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(all_features(spark, sf_dir), ("client_id", "family", "family_id"), BLOCK)


@query(sql(rounded_sql("cross_f", ("client_id", "family"), CROSS)))
def cross_family_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(all_features(spark, sf_dir), ("client_id", "family"), CROSS)


_X = ("x_max_prob", "x_max_n", "x_min_next", "x_n_fam", "x_max_active")


@query(sql(f"""SELECT client_id, family, CAST(family_id AS INT) AS family_id, c_rows, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("p_next", "p_prob", *_X))} FROM (SELECT client_id, family, family_id, c_rows, p_next, p_prob FROM feat UNION ALL SELECT client_id, 'none', 7, c_rows, NULL, NULL FROM cfull)
JOIN (SELECT client_id, max(p_prob) AS x_max_prob, max(p_n) AS x_max_n, min(p_next) AS x_min_next, CAST(count(*) FILTER (n_streams > 0) AS DOUBLE) AS x_n_fam, max(n_active) AS x_max_active FROM ff GROUP BY client_id) USING (client_id)"""))  # fmt: skip
def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.candidate_rows(all_features(spark, sf_dir)), ("client_id", "family", "family_id", "c_rows"), ("p_next", "p_prob", *_X))


_W = ("p_next", "p_prob", "n_streams", "e_ref")


@query(sql(f"""SELECT client_id, any_value(c_rows) AS c_rows, any_value(c_n_active) AS c_n_active, {", ".join(f"round(CAST(max({c}) FILTER (family = '{f}') AS DOUBLE), 6) AS {f}__{c}" for f in C.FAMILIES for c in _W)} FROM feat GROUP BY client_id"""))
def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = features.wide_features(all_features(spark, sf_dir), features.NOISE_LEVEL[2:])
    return rounded(wide, ("client_id", "c_rows", "c_n_active"), [f"{f}__{c}" for f in C.FAMILIES for c in _W])


