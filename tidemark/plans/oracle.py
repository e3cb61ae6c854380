"""DuckDB SQL for the queries' rows, written apart from the Spark plans. Named common table expressions
are put together by `sql(body)`, which adds those that the body and they themselves name."""

from __future__ import annotations

import re

from tidemark.functions import constants as C


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def each(text: str, values=C.FAMILIES, by: str = ", ") -> str:
    """text with {f} and {i} (from 1) for every value."""
    return by.join(text.replace("{f}", str(f)).replace("{i}", str(i + 1)) for i, f in enumerate(values))


_DESCRIBE = f"""
  SELECT *, CASE WHEN type = 'refund' THEN base
    WHEN row_id % 10 = 4 THEN 'pay ' || base || ' online' WHEN row_id % 10 = 5 THEN 'member ' || base
    WHEN row_id % 10 = 6 THEN split_part(base, ' ', 1) WHEN row_id % 10 = 7 THEN {_list(C.GENERIC_SUBSCRIPTION)}[k % 4 + 1]
    WHEN row_id % 10 = 8 THEN {_list(C.EVERYDAY)}[k % 10 + 1]
    WHEN row_id % 10 = 9 AND k % 2 = 0 THEN {_list(C.GENERIC_EVERYDAY)}[k % 4 + 1]
    WHEN row_id % 10 = 9 THEN 'alien vendor ' || k ELSE base END AS description,
    CASE WHEN k % 10 = 0 THEN {_list(C.CARD_MCCS)}[row_id % 10 + 1] ELSE {_list([C.FAMILY_MCC[f] for f in C.FAMILIES])}[fam + 1] END AS mcc,
    CASE WHEN k % 20 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS fee
  FROM (SELECT *, [{", ".join(_list(C.FAMILY_NAMES[f][:4]) for f in C.FAMILIES)}][fam + 1][row_id % 4 + 1] AS base FROM"""

_RECORD_SOFT = "sum(CASE WHEN {cond} THEN {value} ELSE 0.0 END)"

CTES: dict[str, str] = {
    "raw_txn": f"""{_DESCRIBE} (SELECT event_id AS row_id, 'C' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS client_id, CAST(ts AS TIMESTAMP) AS timestamp,
    CAST(ts AS DATE) AS date, date_diff('day', DATE '2024-02-01', CAST(ts AS DATE)) AS day,
    (epoch_us(CAST(ts AS TIMESTAMP)) - epoch_us(TIMESTAMP '2024-02-01')) / 86400000000.0::DOUBLE AS dayf, value AS amount, k,
    CASE WHEN k % 10 < 7 THEN 'chf' WHEN k % 10 < 9 THEN 'eur' ELSE 'usd' END AS currency,
    CASE WHEN event_type = 'error' OR (event_type = 'signup' AND event_id % 5 = 0) THEN 'in' ELSE 'out' END AS direction,
    CASE WHEN event_type = 'error' THEN 'refund' WHEN event_type = 'signup' THEN ['topup','p2p_transfer','transfer','atm','fee'][event_id % 5 + 1] ELSE 'card_payment' END AS type,
    CASE WHEN value > 0 THEN CAST(((floor(ln(CASE WHEN value > 0 THEN value END) * 8) % 7) + 7) % 7 AS INT) END AS fam
    FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)))""",
    "txn": "SELECT * EXCLUDE (fam, base, k) FROM raw_txn WHERE amount > 0",
    "long_txn": f"""{_DESCRIBE} (SELECT *, CASE WHEN flag = 'R' THEN 'in' ELSE 'out' END AS direction, CASE WHEN flag = 'R' THEN 'refund' ELSE 'card_payment' END AS type,
    CAST(((floor(ln(amount) * 8) % 7) + 7) % 7 AS INT) AS fam FROM (
    SELECT CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(l_quantity AS BIGINT)), 1, 13) AS BIGINT) AS row_id,
    'C' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS client_id, CAST(l_shipdate AS TIMESTAMP) AS timestamp, CAST(l_shipdate AS DATE) AS date,
    date_diff('day', DATE '2002-01-01', CAST(l_shipdate AS DATE)) AS day, (epoch_us(CAST(l_shipdate AS TIMESTAMP)) - epoch_us(TIMESTAMP '2002-01-01')) / 86400000000.0::DOUBLE AS dayf,
    l_extendedprice AS amount, CAST(l_partkey % 100 AS INT) AS k, CASE WHEN l_linestatus = 'O' THEN 'chf' ELSE 'eur' END AS currency, l_returnflag AS flag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice > 0)))""",
    # --- grammar
    "base": f"SELECT * FROM (VALUES {_rows((b,) for b in C.BASES)}) v(b)",
    "base_family": f"SELECT * FROM (VALUES {_rows((n, f) for f in C.FAMILIES for n in C.FAMILY_NAMES[f])}) v(b, f)",
    "base_kind": f"SELECT * FROM (VALUES {_rows((n, k, p) for p, k in enumerate(C.KINDS) for n in C.KIND_MEMBERS[k])}) v(b, kind, prio)",
    "trunc": "SELECT DISTINCT t, b FROM (SELECT split_part(b, ' ', 1) AS t, b FROM base WHERE contains(b, ' ') UNION ALL SELECT split_part(b, ' ', -1), b FROM base WHERE contains(b, ' '))",
    "abbr": f"SELECT * FROM (VALUES {_rows(C.ABBREVIATIONS.items())}) v(a, x)",
    "tok": r"SELECT description, list_filter(regexp_split_to_array(description, '\s+'), lambda x: x <> '') AS t FROM (SELECT DISTINCT description FROM txn)",
    "cand": f"""SELECT description, p, q, array_to_string(list_transform(t[p + 1 : len(t) - q],
    lambda x: CASE x {" ".join(f"WHEN '{a}' THEN '{x}'" for a, x in C.ABBREVIATIONS.items())} ELSE x END), ' ') AS core, len(t) - p - q AS size
    FROM tok, range(3) a(p), range(3) c(q) WHERE p <= len(t) - 1 AND q <= len(t) - p - 1
    AND len(list_filter(t[1 : p], lambda x: x NOT IN {_in(C.PREFIXES)})) = 0 AND len(list_filter(t[len(t) - q + 1 : len(t)], lambda x: x NOT IN {_in(C.SUFFIXES)})) = 0""",
    "typed": """SELECT description, p, q, core, CASE WHEN core IN (SELECT b FROM base) THEN 0 WHEN size = 1 AND core IN (SELECT t FROM trunc) THEN 1 END AS kind FROM cand""",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY description ORDER BY kind, p + q, p, q) AS rn FROM typed WHERE kind IS NOT NULL) WHERE rn = 1",
    "loose": f"""SELECT DISTINCT description, b FROM (SELECT description, coalesce(x, w) AS w FROM (SELECT description, unnest(t) AS w FROM tok WHERE description NOT IN (SELECT description FROM best)) LEFT JOIN abbr ON a = w)
    JOIN trunc ON trunc.t = w WHERE w NOT IN {_in((*C.PREFIXES, *C.SUFFIXES))}""",
    "named": "SELECT description, core AS b FROM best WHERE kind = 0 UNION ALL SELECT description, b FROM best JOIN trunc ON t = core WHERE kind = 1 UNION ALL SELECT description, b FROM loose",
    "parsed": """SELECT tok.description, coalesce(list_sort(list(named.b) FILTER (named.b IS NOT NULL)), []) AS bases, CAST(coalesce(any_value(best.p + best.q), 99) AS INT) AS stripped, coalesce(any_value(best.kind) = 0, false) AS exact
    FROM tok LEFT JOIN named USING (description) LEFT JOIN best USING (description) GROUP BY tok.description""",
    "weighted": "SELECT description, b, 1.0::DOUBLE / count(*) OVER (PARTITION BY description) AS w FROM named",
    "fam_weight": "SELECT description, f, sum(w / nf) AS w FROM weighted JOIN (SELECT b, f, count(*) OVER (PARTITION BY b) AS nf FROM base_family) USING (b) GROUP BY description, f",
    "fam_share": "SELECT description, f, w / sum(w) OVER (PARTITION BY description) AS w FROM fam_weight",
    "kinds": "SELECT description, max_by(kind, struct_pack(w := round(w, 9), prio := prio)) AS kind FROM (SELECT description, kind, prio, sum(w) AS w FROM weighted JOIN base_kind USING (b) GROUP BY ALL) GROUP BY description",
    "ev": f"""SELECT tok.description, coalesce(any_value(kinds.kind), 'unknown') AS kind, {each("coalesce(max(w) FILTER (f = '{f}'), 0.0::DOUBLE) AS d_{f}")}
    FROM tok LEFT JOIN kinds USING (description) LEFT JOIN fam_share USING (description) GROUP BY tok.description""",
    "de": "SELECT * FROM txn JOIN ev USING (description)",
    # --- streams
    "main_cur": "SELECT client_id, currency AS main_currency FROM (SELECT client_id, currency, row_number() OVER (PARTITION BY client_id ORDER BY count(*) DESC, currency) AS rn FROM txn GROUP BY client_id, currency) WHERE rn = 1",
    "sub": f"SELECT * FROM de WHERE type = 'card_payment' AND kind IN {_in(C.SUBSCRIPTION_KINDS)}",
    "isl": """SELECT * EXCLUDE (step), CAST(sum(CASE WHEN step > 0.035 THEN 1 ELSE 0 END) OVER (PARTITION BY client_id, currency ORDER BY amount, row_id) AS BIGINT) AS sid
    FROM (SELECT *, ln(amount) - lag(ln(amount)) OVER (PARTITION BY client_id, currency ORDER BY amount, row_id) AS step FROM sub)""",
    "mccs": "SELECT client_id, currency, sid, mcc AS mcc_main, n AS mcc_n FROM (SELECT client_id, currency, sid, mcc, count(*) AS n, row_number() OVER (PARTITION BY client_id, currency, sid ORDER BY count(*) DESC, mcc) AS rn FROM isl GROUP BY client_id, currency, sid, mcc) WHERE rn = 1",
    "med": """SELECT client_id, currency, sid, median(amount) AS amt, median(ln(amount)) AS lam, median(gap) AS per FROM
    (SELECT *, day - lag(day) OVER (PARTITION BY client_id, currency, sid ORDER BY day, timestamp, row_id) AS gap FROM isl) GROUP BY ALL""",
    "srow": """SELECT isl.*, amt, lam, per, mcc_main, mcc_n, day - lag(day) OVER (PARTITION BY client_id, currency, sid ORDER BY day, timestamp, row_id) AS gap,
    row_number() OVER (PARTITION BY client_id, currency, sid ORDER BY day DESC, timestamp DESC, row_id DESC) AS back FROM isl JOIN med USING (client_id, currency, sid) JOIN mccs USING (client_id, currency, sid)""",
    "summ": f"""SELECT client_id, currency, sid, count(*) AS n, min(day) AS first, max(day) AS last, max(day) - min(day) AS span, any_value(per) AS per, any_value(amt) AS amt,
    {each("count(*) FILTER (day > -{f}) AS n{f}", (30, 60, 90, 180))}, {each("max(gap) FILTER (back = {f}) AS gap_last{f}", (1, 2, 3))}, max(gap) AS gap_max, count(*) FILTER (gap < 5) AS n_dup,
    count(*) FILTER (per > 0 AND gap > 1.6 * per) AS n_missed, avg(CASE WHEN per > 0 AND gap IS NOT NULL THEN CAST(abs(gap / per - 1) < 0.2 AS INT) END) AS gap_regular,
    avg(CASE WHEN per > 0 AND gap IS NOT NULL THEN CAST(gap > 1.5 * per AS INT) END) AS skipped_cycle_frac, CASE WHEN count(*) >= 3 THEN median(abs(gap - per)) END AS gap_mad,
    CASE WHEN any_value(per) > 0 THEN max(gap) FILTER (back = 1) / any_value(per) END AS gap_last_ratio, max(ln(amount)) FILTER (back = 1) - any_value(lam) AS amt_last_dev,
    max(abs(ln(amount) - lam)) AS amt_max_absdev, count(*) FILTER (abs(ln(amount) - lam) > 0.03) AS n_outlier, CAST(max(CAST(mcc <> mcc_main AS INT)) FILTER (back = 1) AS DOUBLE) AS swap_last1,
    CAST(sum(CAST(mcc <> mcc_main AS INT)) FILTER (back <= 3) AS DOUBLE) AS swap_last3, CAST(max(CAST(kind = 'generic_sub' AS INT)) FILTER (back = 1) AS DOUBLE) AS generic_last1,
    CAST(sum(CAST(kind = 'generic_sub' AS INT)) FILTER (back <= 3) AS DOUBLE) AS generic_last3, avg(CAST(kind = 'generic_sub' AS INT)) AS generic_frac, avg(CAST(fee > 0 AS INT)) AS fee_frac,
    CASE WHEN count(*) >= 2 THEN stddev_pop(day(date)) END AS dom_std, CASE WHEN count(*) >= 2 THEN stddev_samp(amount) / avg(amount) ELSE 0.0 END AS amt_cv,
    CASE WHEN count(*) >= 2 THEN max(amount) FILTER (back = 1) / max(amount) FILTER (back = total) ELSE 1.0 END AS amt_trend, max(amount) FILTER (back = 1) / max(amount) FILTER (back = 2) - 1 AS amt_change_last,
    CAST(any_value(mcc_n) AS DOUBLE) / count(*) AS mcc_top, {each("sum(CASE WHEN " + " + ".join(f"d_{f}" for f in C.FAMILIES) + " > 0 THEN ln(0.9 * d_{f} + 0.1 / 7) ELSE 0 END) AS dl_{f}")},
    {", ".join(f"sum(ln(CASE WHEN mcc = '{C.FAMILY_MCC[f]}' THEN 0.73 ELSE 0.03 END)) AS ml_{f}" for f in C.FAMILIES)}
    FROM (SELECT *, count(*) OVER (PARTITION BY client_id, currency, sid) AS total FROM srow) GROUP BY client_id, currency, sid""",
    "rmatch": f"""SELECT DISTINCT s.client_id, s.currency, s.sid, r.row_id AS refund_id, r.day AS refund_day, {each("r.d_{f}")} FROM srow s JOIN de r ON r.client_id = s.client_id AND r.currency = s.currency
    WHERE r.type = 'refund' AND abs(r.amount / s.amt - 1) < 0.03 AND r.day - s.day BETWEEN 0 AND 10""",
    "rsum": f"""SELECT client_id, currency, sid, count(*) AS nref, max(refund_day) AS last_ref, max(CAST(refund_day > last AS INT)) AS ref_after_last, max(CAST(refund_day - last BETWEEN 0 AND 10 AS INT)) AS last_refunded,
    count(*) FILTER (refund_day > -60) AS nref60, {each("sum(CASE WHEN " + " + ".join(f"d_{f}" for f in C.FAMILIES) + " > 0 THEN ln(0.95 * d_{f} + 0.05 / 7) ELSE 0 END) AS rl_{f}")}
    FROM rmatch JOIN (SELECT client_id, currency, sid, last FROM summ) USING (client_id, currency, sid) GROUP BY ALL""",
    # --- amount prior
    "pisl": """SELECT * EXCLUDE (step), sum(CASE WHEN step > 0.035 THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY amount, row_id) AS sid FROM (SELECT *, ln(amount) - lag(ln(amount)) OVER (PARTITION BY client_id ORDER BY amount, row_id) AS step
    FROM de WHERE type = 'card_payment' AND kind IN ('fam', 'generic_sub'))""",
    "pfam": f"""SELECT client_id, sid, f, count(*) AS k, min(struct_pack(amount := amount, row_id := row_id)) AS seen FROM (SELECT client_id, sid, amount, row_id, CASE {" ".join(f"WHEN d_{f} = 1 THEN '{f}'" for f in C.FAMILIES)} END AS f FROM pisl) WHERE f IS NOT NULL GROUP BY ALL""",
    "pstream": """SELECT client_id, sid, n, f AS family, amount FROM (SELECT *, row_number() OVER (PARTITION BY client_id, sid ORDER BY k DESC, seen) AS rn FROM pfam)
    JOIN (SELECT client_id, sid, count(*) AS n, median(amount) AS amount FROM pisl GROUP BY client_id, sid) USING (client_id, sid) WHERE rn = 1 AND n >= 3 AND k >= 2 AND k >= 0.6 * n""",
    "grid": f"SELECT f AS family, CAST(bin AS INT) AS bin FROM (VALUES {_rows((f,) for f in C.FAMILIES)}) v(f), range(40) r(bin)",
    "prior": """SELECT family, bin, n, ln((n + 0.5) / sum(n + 0.5) OVER (PARTITION BY family)) AS logp FROM (SELECT grid.family, grid.bin, count(s.family) AS n FROM grid
    LEFT JOIN (SELECT family, CASE WHEN ln(amount) = ln(800.0::DOUBLE) THEN 39 ELSE floor((ln(amount) - ln(1.5::DOUBLE)) / ((ln(800.0::DOUBLE) - ln(1.5::DOUBLE)) / 40)) END AS bin FROM pstream) s ON s.family = grid.family AND s.bin = grid.bin GROUP BY ALL)""",
    "rec0": f"""SELECT summ.* EXCLUDE ({each("dl_{f}")}, {each("ml_{f}")}), coalesce(nref, 0) AS nref, last_ref, CAST(coalesce(ref_after_last, 0) AS DOUBLE) AS ref_after_last, CAST(coalesce(last_refunded, 0) AS DOUBLE) AS last_refunded, coalesce(nref60, 0) AS nref60,
    CAST(currency <> main_currency AS INT)::DOUBLE AS odd_cur, last + coalesce(per, 30) >= -7 AS active, {each("dl_{f} + ml_{f} + coalesce(rl_{f}, 0) + (SELECT logp FROM prior WHERE family = '{f}' AND bin = greatest(0, least(39, ceil((ln(amt) - ln(1.5::DOUBLE)) / ((ln(800.0::DOUBLE) - ln(1.5::DOUBLE)) / 40)) - 1))) AS ll_{f}")}
    FROM summ LEFT JOIN rsum USING (client_id, currency, sid) JOIN main_cur USING (client_id)""",
    "rec": f"""SELECT * EXCLUDE (top, z, {each("ll_{f}")}), {each("exp(ll_{f} - top) / z AS post_{f}")} FROM (SELECT *, {each("exp(ll_{f} - top)", by=" + ")} AS z FROM (SELECT *, greatest({each("ll_{f}")}) AS top FROM rec0))""",
    # --- features
    "cfeat": f"""SELECT * FROM (SELECT client_id, count(*) AS c_rows, {each("count(*) FILTER (type = '{f}') AS c_n_{f}", C.TYPES)}, count(*) FILTER (type = 'refund' AND kind IN ('fam', 'generic_sub')) AS c_sub_refunds,
    count(*) FILTER (type = 'refund' AND kind NOT IN ('fam', 'generic_sub')) AS c_eve_refunds, avg(CAST(fee > 0 AS INT)) AS c_fee_pos, avg(CAST(currency <> main_currency AS INT)) AS c_oddcur, min(day) AS c_first_day,
    {each("count(*) FILTER (day > -{f}) AS c_rows_{f}, count(*) FILTER (type = 'refund' AND day > -{f}) AS c_refunds_{f}", (30, 60, 90))}, count(*) FILTER (type = 'refund' AND kind IN ('fam', 'generic_sub') AND day >= -90) AS c_sub_ref_last90,
    CAST(max(day) FILTER (type = 'refund' AND kind IN ('fam', 'generic_sub')) AS DOUBLE) AS c_last_sub_ref FROM de JOIN main_cur USING (client_id) GROUP BY client_id) LEFT JOIN
    (SELECT client_id, count(*) FILTER (n >= 2) AS c_n_streams, count(*) FILTER (n >= 2 AND active) AS c_n_active, count(*) FILTER (n >= 2 AND NOT active) AS c_n_ended, count(*) FILTER (n >= 2 AND active AND nref > 0) AS c_n_active_ref,
    count(*) FILTER (n >= 2 AND NOT active AND nref > 0) AS c_n_ended_ref, min(last + per) FILTER (n >= 2 AND active) AS c_min_next, count(*) FILTER (n >= 2 AND active AND last + per BETWEEN -7 AND 15) AS c_n_active_early,
    count(*) FILTER (n = 1 AND last >= -45 AND greatest({each("post_{f}")}) > 0.5) AS c_n_recent_singles, coalesce(max(n) FILTER (n >= 2 AND active), 0) AS c_max_act_n, coalesce(min(first) FILTER (n >= 2 AND active), 0) AS c_min_act_first,
    avg(CAST(nref > 0 AS INT)) FILTER (n >= 2) AS c_frac_ref_streams FROM rec GROUP BY client_id) USING (client_id)""",
    "cfull": "SELECT * REPLACE ("
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("c_n_streams", "c_n_active", "c_n_ended", "c_n_active_ref", "c_n_ended_ref", "c_n_active_early", "c_n_recent_singles", "c_max_act_n", "c_min_act_first"))
    + ") FROM cfeat",
    "sf": f"SELECT rec.*, f AS family, CAST(i AS INT) AS family_id, CASE f {each("WHEN '{f}' THEN post_{f}", by=' ')} END AS post FROM rec, (VALUES {_rows((f, i) for i, f in enumerate(C.FAMILIES))}) v(f, i)",
    "soft": f"""SELECT client_id, family, {each("sum(CASE WHEN r THEN post * n{f} ELSE 0 END) AS n_events{f}", (90, 180))}, sum(CASE WHEN r THEN post ELSE 0 END) AS n_streams, sum(CASE WHEN r AND active THEN post ELSE 0 END) AS n_active,
    sum(CASE WHEN r AND NOT active AND nref > 0 THEN post ELSE 0 END) AS n_ended_ref, CAST(min(CASE WHEN r AND active THEN last + coalesce(per, 30) END) AS DOUBLE) AS earliest_plausible_next,
    {each("sum(CASE WHEN r AND active AND last + coalesce(per, 30) <= {f} THEN post ELSE 0 END) AS active_due_{f}_mass", (30, 60, 90))}, count(*) FILTER (s) AS s_n
    FROM (SELECT *, n >= 2 AND post >= 0.15 AS r, n = 1 AND post >= 0.15 AND last >= -62 AS s FROM sf) GROUP BY client_id, family""",
    "prim": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, family ORDER BY active DESC, post > 0.5 DESC, last DESC, n DESC, currency, sid) AS rn FROM sf WHERE n >= 2 AND post >= 0.15) WHERE rn = 1",
    "sing": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, family ORDER BY post DESC, last DESC, currency, sid) AS rn FROM sf WHERE n = 1 AND post >= 0.15 AND last >= -62) WHERE rn = 1",
    "eref": f"SELECT client_id, {each("sum(d_{f}) AS e_{f}")} FROM de WHERE type = 'refund' GROUP BY client_id",
    "ff": "SELECT c.client_id, v.f AS family, CAST(v.i AS INT) AS family_id, "
    + "coalesce(CASE v.f "
    + each("WHEN '{f}' THEN e_{f}", by=" ")
    + " END, 0) AS e_ref, "
    + ", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in ("n_events90", "n_events180", "n_streams", "n_active", "n_ended_ref", "active_due_30_mass", "active_due_60_mass", "active_due_90_mass", "s_n"))
    + ", s.earliest_plausible_next, p.post AS p_prob, p.nref::DOUBLE / p.n AS p_ref_rate, CASE WHEN p.client_id IS NULL THEN NULL WHEN p.per > 0 THEN p.per ELSE 30.0 END AS p_per, p.last + CASE WHEN p.per > 0 THEN p.per ELSE 30.0 END AS p_next, -p.last / CASE WHEN p.per > 0 THEN p.per ELSE 30.0 END AS p_overdue, CAST(p.active AS INT)::DOUBLE AS p_active, "
    + ", ".join(
        f"CAST(p.{c} AS DOUBLE) AS p_{c}"
        for c in (
            "n", "last", "first", "span", "gap_mad", "gap_last1", "gap_last2", "gap_last3", "gap_max", "skipped_cycle_frac", "amt", "amt_cv", "amt_trend", "amt_change_last", "nref", "last_refunded", "last_ref", "odd_cur", "generic_frac", "mcc_top",
            "n30", "n60", "n90", "n180", "gap_last_ratio", "n_dup", "n_missed", "gap_regular", "amt_last_dev", "amt_max_absdev", "n_outlier", "swap_last1", "swap_last3", "generic_last1", "generic_last3", "fee_frac", "dom_std", "ref_after_last", "nref60",
        )
    )
    + f""", g.post AS s_prob, CAST(g.last AS DOUBLE) AS s_last, (SELECT logp FROM prior WHERE prior.family = v.f AND bin = greatest(0, least(39, ceil((ln(g.amt) - ln(1.5::DOUBLE)) / ((ln(800.0::DOUBLE) - ln(1.5::DOUBLE)) / 40)) - 1))) AS s_amt_logp
    FROM (SELECT DISTINCT client_id FROM txn) c CROSS JOIN (VALUES {_rows((f, i) for i, f in enumerate(C.FAMILIES))}) v(f, i) LEFT JOIN eref ON eref.client_id = c.client_id
    LEFT JOIN soft s ON s.client_id = c.client_id AND s.family = v.f LEFT JOIN prim p ON p.client_id = c.client_id AND p.family = v.f LEFT JOIN sing g ON g.client_id = c.client_id AND g.family = v.f""",
    "cross_f": """SELECT a.client_id, a.family, count(b.family) FILTER (b.family <> a.family) AS n_other_active, CASE WHEN any_value(a.p_active) = 1 THEN any_value(a.p_next) - min(b.p_next) FILTER (b.family <> a.family) END AS rel_next_minus_best_other,
    CASE WHEN any_value(a.p_active) = 1 THEN CAST(count(*) FILTER (b.p_next < a.p_next) AS DOUBLE) END AS next_rank, CASE WHEN any_value(a.p_active) = 1 THEN CAST(count(*) FILTER (b.p_n > a.p_n) AS DOUBLE) END AS n_rank,
    CASE WHEN any_value(a.p_active) = 1 THEN CAST(count(*) FILTER (b.p_last > a.p_last) AS DOUBLE) END AS last_rank FROM ff a LEFT JOIN ff b ON a.client_id = b.client_id AND b.p_active = 1 GROUP BY a.client_id, a.family""",
    "feat": "SELECT * FROM ff JOIN cross_f USING (client_id, family) JOIN cfull USING (client_id)",
    "lab": f"SELECT client_id, {_list(C.CLASSES)}[{'h'} % 8 + 1] AS label FROM (SELECT DISTINCT client_id, list_sum(list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256(client_id), CAST(i AS INT), 1)) - 1))::INT AS h FROM txn)",
    "split": "SELECT client_id, ['train', 'valid', 'test', 'unlabeled'][h % 4 + 1] AS split FROM (SELECT DISTINCT client_id, list_sum(list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256('split:' || client_id), CAST(i AS INT), 1)) - 1))::INT AS h FROM txn)",
}


def digits(text: str) -> str:
    """Sum of the hex digits of sha256(text)."""
    return f"list_sum(list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256({text}), CAST(i AS INT), 1)) - 1))::INT"


def uniform(seed: int, key: str, draw: str) -> str:
    return f"(CAST('0x' || substr(sha256('{seed}:' || {key} || ':{draw}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def sql(body: str, more: dict[str, str] | None = None) -> str:
    """body with the common table expressions it needs in front."""
    known = CTES | (more or {})
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need(known[name])
                order.append(name)

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS (\n{known[n]})" for n in order) + "\n" if order else "") + body
