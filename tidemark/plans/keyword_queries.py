"""Queries of the keyword stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.operators import keyword
from tidemark.plans.evaluation_queries import _MORE as _SCORES
from tidemark.plans.oracle import each, sql
from tidemark.plans.registry import query, rounded, rounded_sql
from tidemark.sources import adapters


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_KW = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(description, '{k}')" if " " in k else f"list_contains(string_split(description, ' '), '{k}')" for k in ks) + f" THEN '{f}'" for f, ks in C.KEYWORDS.items()) + " END"
_MAIN = "CASE fam " + " ".join(f"WHEN '{f}' THEN {m}" for f, m in C.FAMILY_MCC.items()) + " END"
_T = {
    "prep": f"SELECT * REPLACE (CAST(mcc AS INT) AS mcc), {_KW} AS kwfam, CASE CAST(mcc AS INT) {' '.join(f"WHEN {m} THEN '{f}'" for m, f in C.KEYWORD_MCC.items())} END AS mccfam, description IN {_in(C.GENERIC_EVERYDAY)} AS isnoise, description IN {_in(C.NON_RECURRING)} AS isnonrec FROM txn",
    "kc": "SELECT * FROM prep WHERE direction = 'out' AND type = 'card_payment' AND NOT isnoise AND NOT isnonrec",
    "ki": "SELECT *, sum(CASE WHEN step > 0.04 THEN 1 ELSE 0 END) OVER (PARTITION BY client_id, kwfam ORDER BY amount, row_id) AS cluster FROM (SELECT *, ln(amount) - lag(ln(amount)) OVER (PARTITION BY client_id, kwfam ORDER BY amount, row_id) AS step FROM kc WHERE kwfam IS NOT NULL)",
    "anch": "SELECT client_id, kwfam, cluster, median(ln(amount)) AS anchor, count(*) AS support FROM ki GROUP BY client_id, kwfam, cluster",
    "near": "SELECT k.row_id, a.kwfam, a.cluster, abs(a.anchor - ln(k.amount)) AS d, support FROM kc k JOIN anch a ON a.client_id = k.client_id WHERE k.kwfam IS NULL",
    "pick": "SELECT row_id, CASE WHEN d1 < 0.08 THEN f1 ELSE f2 END AS anchored FROM (SELECT row_id, kwfam AS f1, d AS d1 FROM near QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d / sqrt(support), kwfam, cluster) = 1) JOIN (SELECT row_id, kwfam AS f2 FROM near WHERE d < 0.08 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, kwfam, cluster) = 1) USING (row_id)",
    "asg": "SELECT kc.*, coalesce(kwfam, anchored, mccfam, CASE WHEN mcc = 5812 THEN 'amb5812' END, 'unknown') AS fam FROM kc LEFT JOIN pick USING (row_id)",
    "arow": "SELECT *, ln(amount) AS la, dayf - lag(dayf) OVER (PARTITION BY client_id, fam ORDER BY dayf, row_id) AS gap, row_number() OVER (PARTITION BY client_id, fam ORDER BY dayf DESC, row_id DESC) AS back FROM asg",
    "amed": "SELECT client_id, fam, median(la) AS med, median(gap) AS medgap FROM arow GROUP BY client_id, fam",
    "acur": "SELECT client_id, fam, currency AS mode_cur FROM (SELECT client_id, fam, currency, row_number() OVER (PARTITION BY client_id, fam ORDER BY count(*) DESC, currency) AS rn FROM arow GROUP BY client_id, fam, currency) WHERE rn = 1",
    "aflag": f"SELECT arow.*, med, medgap, mode_cur, kwfam IS NULL AS unnamed, description NOT IN {_in(C.CLEAN)} AS noisy, description IN {_in(C.GENERIC_SUBSCRIPTION)} AS generic, mcc <> {_MAIN} AS swapped FROM arow JOIN amed USING (client_id, fam) JOIN acur USING (client_id, fam)",
    "tl0": f"""SELECT client_id, fam, count(*) AS n, min(dayf) AS first, max(dayf) AS last, max(dayf) - min(dayf) AS span, count(kwfam) AS n_named, avg(CAST(unnamed AS INT)) AS frac_generic, sum(CAST(unnamed AS INT)) FILTER (back <= 3) AS generic_last3, sum(CAST(unnamed AS INT)) FILTER (back = 1) AS generic_last1,
    avg(CAST(noisy AS INT)) AS frac_noisy, sum(CAST(noisy AS INT)) FILTER (back <= 3) AS noisy_last3, count(*) FILTER (noisy) AS n_noisy, avg(CAST(generic AS INT)) AS frac_gen_exact, avg(CAST(swapped AS INT)) AS swap_frac, sum(CAST(swapped AS INT)) FILTER (back = 1) AS swap_last1,
    sum(CAST(swapped AS INT)) FILTER (back <= 3) AS swap_last3, sum(CAST(swapped AS INT)) AS n_swap, avg(CAST(swapped AS INT)) + avg(CAST(noisy AS INT)) + avg(CAST(generic AS INT)) + avg(CAST(fee > 0 AS INT)) AS noise_score, sum(CAST(NOT swapped AND NOT noisy AND NOT generic AS INT)) FILTER (swapped IS NOT NULL) AS n_clean,
    count(DISTINCT mcc) AS n_mcc, count(DISTINCT description) AS n_desc, count(DISTINCT currency) AS n_cur, avg(CAST(fee > 0 AS INT)) AS fee_frac, sum(CAST(fee > 0 AS INT)) FILTER (back = 1) AS fee_last, sum(CAST(currency <> mode_cur AS INT)) FILTER (back = 1) AS cur_last_diff,
    any_value(med) AS logamt, stddev_pop(la) AS amt_cv, max(la) - min(la) AS amt_range, max(la) FILTER (back = 1) - any_value(med) AS last_amt_dev, abs(max(la) FILTER (back = 1) - any_value(med)) AS last_amt_absdev, max(abs(la - med)) AS max_absdev, count(*) FILTER (abs(la - med) > 0.03) AS n_outlier,
    CASE WHEN count(*) >= 3 THEN regr_slope(la, dayf) * 30 END AS amt_slope, {each("count(*) FILTER (dayf > -{f}) AS n{f}", (30, 45, 60, 90, 180))}, any_value(medgap) AS medgap, avg(gap) AS meangap, stddev_pop(gap) AS gap_std, min(gap) AS min_gap, max(gap) AS max_gap, max(gap) FILTER (back = 1) AS last_gap,
    CASE WHEN any_value(medgap) > 0 THEN max(gap) FILTER (back = 1) / any_value(medgap) END AS last_gap_ratio, max(dayf) + any_value(medgap) AS due, CASE WHEN any_value(medgap) > 0 THEN -max(dayf) / any_value(medgap) END AS overdue, max(dayf) + avg(gap) AS due_mean, CASE WHEN count(*) >= 2 THEN count(*) FILTER (gap < 5) END AS n_dup,
    CASE WHEN count(*) >= 2 THEN count(*) FILTER (gap > 1.6 * medgap) END AS n_missed, avg(CASE WHEN gap IS NOT NULL THEN CASE WHEN medgap > 0 AND abs(gap / medgap - 1) < 0.2 THEN 1 ELSE 0 END END) AS reg, count(*) FILTER (dayf > -90) * any_value(medgap) / 90.0 AS cov90, CASE WHEN count(*) >= 2 THEN stddev_pop(day(timestamp)) END AS dom_std
    FROM aflag GROUP BY client_id, fam""",
    "tref": "SELECT client_id, fam, count(*) AS nref, max(r.dayf) AS ref_last, max(CAST(r.dayf > last AS INT)) AS ref_after_last, count(*) FILTER (r.dayf > -60) AS nref60 FROM tl0 JOIN (SELECT client_id, amount, dayf, kwfam FROM prep WHERE type = 'refund') r USING (client_id) WHERE abs(ln(r.amount / exp(logamt))) < 0.1 OR r.kwfam = fam GROUP BY client_id, fam",
    "tl": "SELECT tl0.*, coalesce(nref, 0) AS nref, coalesce(ref_last, -999) AS ref_last, coalesce(ref_after_last, 0) AS ref_after_last, coalesce(nref60, 0) AS nref60, coalesce(nref, 0) / n AS nref_frac FROM tl0 LEFT JOIN tref USING (client_id, fam)",
    "kl": f"SELECT c.client_id, v.f AS fam, CAST(v.i AS INT) AS fam_id, coalesce(n, 0) AS n, n90, last, due, coalesce(n >= 2 AND last > -75 AND due IS NOT NULL, false) AS act FROM (SELECT DISTINCT client_id FROM txn) c CROSS JOIN (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(C.FAMILIES))}) v(f, i) LEFT JOIN tl ON tl.client_id = c.client_id AND tl.fam = v.f",
    "kr": """SELECT a.client_id, a.fam, CASE WHEN a.act THEN count(*) FILTER (b.act AND (b.due < a.due OR (b.due = a.due AND b.fam_id < a.fam_id))) WHEN bool_or(b.act) THEN -1 END AS f_due_rank, CASE WHEN a.act THEN count(*) FILTER (b.act AND (b.n > a.n OR (b.n = a.n AND b.fam_id < a.fam_id))) WHEN bool_or(b.act) THEN -1 END AS f_n_rank,
    CASE WHEN a.act THEN count(*) FILTER (b.act AND (b.last > a.last OR (b.last = a.last AND b.fam_id < a.fam_id))) WHEN bool_or(b.act) THEN -1 END AS f_last_rank, count(*) FILTER (b.act) AS n_active, min(b.due) FILTER (b.act) AS min_due, CASE WHEN a.n >= 2 THEN a.due - min(b.due) FILTER (b.act) END AS f_due_minus_min,
    max(b.n) FILTER (b.fam <> a.fam) AS oth_max_n, sum(b.n) FILTER (b.fam <> a.fam) AS oth_sum_n, count(*) FILTER (b.fam <> a.fam AND b.last > -60) AS oth_n_active, min(b.due) FILTER (b.fam <> a.fam AND b.last > -75) AS oth_min_due, a.due - min(b.due) FILTER (b.fam <> a.fam AND b.last > -75) AS due_minus_oth_min, max(coalesce(b.n90, 0)) FILTER (b.fam <> a.fam) AS oth_max_n90
    FROM kl a JOIN kl b USING (client_id) GROUP BY a.client_id, a.fam, a.act, a.due, a.n, a.last, a.fam_id""",
}
_LINE = (
    "n", "first", "last", "span", "n_named", "frac_generic", "generic_last3", "generic_last1", "frac_noisy", "noisy_last3", "n_noisy", "frac_gen_exact", "swap_frac", "swap_last1", "swap_last3", "n_swap", "noise_score", "n_clean", "n_mcc", "n_desc", "n_cur",
    "fee_frac", "fee_last", "cur_last_diff", "logamt", "amt_cv", "amt_range", "last_amt_dev", "last_amt_absdev", "max_absdev", "n_outlier", "amt_slope", "n30", "n45", "n60", "n90", "n180", "medgap", "meangap", "gap_std", "min_gap", "max_gap", "last_gap", "last_gap_ratio",
    "due", "overdue", "due_mean", "n_dup", "n_missed", "reg", "cov90", "dom_std", "nref", "ref_last", "ref_after_last", "nref60", "nref_frac",
)
_RANKS = ("f_due_rank", "f_n_rank", "f_last_rank", "f_due_minus_min", "n_active", "min_due")
_OTHERS = ("oth_max_n", "oth_sum_n", "oth_n_active", "oth_min_due", "due_minus_oth_min", "oth_max_n90")
_SUMMARY = ("n_txn", "first_txn", "last_txn", *(f"n_{t}" for t in C.TYPES), "n_in", "n_cur", "n_noise", "n_nonrec", "fee_sum", "n_feepos", "salary_sum", "out_sum", *(f"n_{k}{w}" for k in ("ref", "txn") for w in (30, 60, 90, 180)), "ref_rec_named", "ref_generic", "ref_nonrec", "main_cur", "n_cand", "n_amb", "n_unknown", "n_fam_present")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.prepare(adapters.transactions(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _prepared(spark, sf_dir)
    assigned = keyword.assign_family(rows)
    return rows, assigned, keyword.timeline(assigned, rows.where("type = 'refund'"))


@query(sql(f"SELECT DISTINCT description, {_KW} AS kwfam FROM txn"))
def keyword_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.transactions(spark, sf_dir).select("description").distinct()
    return rows.withColumn("kwfam", keyword.keyword_family(F.col("description")))


@query(sql("SELECT client_id, kwfam, cluster, round(anchor, 6) AS anchor, support FROM anch", _T))
def amount_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prepared(spark, sf_dir).where(F.col("cand") & F.col("kwfam").isNotNull())
    return rounded(keyword.anchors(rows), ("client_id", "kwfam", "cluster", "support"), ("anchor",))


@query(sql("SELECT row_id, client_id, fam FROM asg", _T))
def assign_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.assign_family(_prepared(spark, sf_dir)).select("row_id", "client_id", "fam")


@query(sql(rounded_sql("tl", ("client_id", "fam"), _LINE, 5), _T))
def timeline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lines(spark, sf_dir)[2], ("client_id", "fam"), _LINE, 5)


@query(sql(f"""SELECT client_id, {", ".join(f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in _SUMMARY)} FROM (SELECT client_id, count(*) AS n_txn, min(dayf) AS first_txn, max(dayf) AS last_txn, {each("count(*) FILTER (type = '{f}') AS n_{f}", C.TYPES)}, count(*) FILTER (direction = 'in') AS n_in, count(DISTINCT currency) AS n_cur, count(*) FILTER (isnoise) AS n_noise, count(*) FILTER (isnonrec) AS n_nonrec,
sum(fee) AS fee_sum, count(*) FILTER (fee > 0) AS n_feepos, coalesce(sum(amount) FILTER (description = 'salary'), 0) AS salary_sum, coalesce(sum(amount) FILTER (direction = 'out'), 0) AS out_sum, {each("count(*) FILTER (type = 'refund' AND dayf > -{f}) AS n_ref{f}, count(*) FILTER (dayf > -{f}) AS n_txn{f}", (30, 60, 90, 180))}, count(*) FILTER (type = 'refund' AND kwfam IS NOT NULL) AS ref_rec_named,
count(*) FILTER (type = 'refund' AND description IN {_in(C.GENERIC_SUBSCRIPTION)}) AS ref_generic, count(*) FILTER (type = 'refund' AND isnonrec) AS ref_nonrec FROM prep GROUP BY client_id) JOIN (SELECT client_id, list_position(['chf', 'eur', 'usd', 'gbp'], main_currency) - 1 AS main_cur FROM main_cur) USING (client_id)
JOIN (SELECT client_id, count(fam) AS n_cand, count(*) FILTER (fam = 'amb5812') AS n_amb, count(*) FILTER (fam = 'unknown') AS n_unknown, count(DISTINCT fam) FILTER (fam NOT IN ('amb5812', 'unknown')) AS n_fam_present FROM (SELECT DISTINCT client_id FROM txn) LEFT JOIN asg USING (client_id) GROUP BY client_id) USING (client_id)""", _T))  # fmt: skip
def keyword_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, assigned, _ = _lines(spark, sf_dir)
    return rounded(keyword.client_summary(rows, assigned), ("client_id",), _SUMMARY)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, lines = _lines(spark, sf_dir)
    return keyword.families_long(rows.select("client_id").distinct(), lines)


@query(sql(rounded_sql("kr", ("client_id", "fam"), _RANKS), _T))
def keyword_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_long(spark, sf_dir), ("client_id", "fam"), _RANKS)


@query(sql("SELECT client_id, fam, round(CAST(kl.n AS DOUBLE), 6) AS f_n, round(kl.due, 6) AS f_due, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _OTHERS) + " FROM kr JOIN kl USING (client_id, fam)", _T))
def to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_long(spark, sf_dir), ("client_id", "fam"), ("f_n", "f_due", *_OTHERS))


_LOGIT = {f: f"ln(least(greatest({f}, 1e-4), 1 - 1e-4) / (1 - least(greatest({f}, 1e-4), 1 - 1e-4)))" for f in C.FAMILIES}


@query(sql(f"SELECT client_id, {', '.join(f'round(l_{f}, 6) AS logit_{f}' for f in C.FAMILIES)}, round(s[1], 6) AS top1, round(s[2], 6) AS top2, round(s[1] - s[2], 6) AS margin FROM (SELECT *, list_reverse_sort([{', '.join(f'l_{f}' for f in C.FAMILIES)}]) AS s FROM (SELECT client_id, {', '.join(f'{x} AS l_{f}' for f, x in _LOGIT.items())} FROM p0))", _SCORES))
def stage_two_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = adapters.clients(adapters.transactions(spark, sf_dir))
    found = keyword.stage_two_inputs(adapters.scores(people, 0))
    return rounded(found, ("client_id",), [*(f"logit_{f}" for f in C.FAMILIES), "top1", "top2", "margin"])
