"""Queries of scored models, with SQL for the same rows.

A fit takes hundreds of rounds of Spark jobs and cannot be written in SQL, so the fits are covered by tests and
the workflows. The queries score stored models, whose trees follow a rule: tree i splits on feature i, below
that on two others, at cuts and with values that i gives. Every feature of the candidates is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.operators import boosting, features, keyword, logistic, models, validate
from tidemark.operators.boosting import Model, Settings
from tidemark.plans.keyword_queries import _T, _lines
from tidemark.plans.oracle import sql
from tidemark.plans.parser_queries import BLOCK, CLIENT, CROSS, all_features
from tidemark.plans.registry import query, rounded
from tidemark.sources import adapters

#: Cuts of every feature of a stored model: no value that features take exactly.
CUTS = [-91.37, -33.71, -9.13, -1.37, 0.137, 0.371, 0.713, 1.37, 3.71, 17.13, 71.37]


def stored_model(names: list[str], objective: str) -> Model:
    """A tree of depth 2 for each name, by the rule above."""
    trees, n = [], len(names)
    for i in range(n):
        nodes = [[i, (3 * i + 4) % len(CUTS), i % 2, 1, 2, 0.0, 1.0 + i % 7]]
        for side in (1, 2):
            nodes.append([(i + 3 * side) % n, (5 * i + side) % len(CUTS), (i + side) % 2, 2 * side + 1, 2 * side + 2, ((i + 2 * side) % 5 - 2) / 16, 0.5 + (i + side) % 3])
        nodes += [[-1, 0, 0, 0, 0, ((7 * i + 3 * leaf) % 13 - 6) / 32, 0.0] for leaf in range(4)]
        trees.append(nodes)
    return Model(list(names), [CUTS] * n, Settings(objective, depth=2), -0.25 if objective == "binary" else 0.0, trees)


def _goes_left(model: Model, node: list, column) -> str:
    name = column(model.features[int(node[0])])
    known = f"{name} <= {CUTS[int(node[1])]!r}::DOUBLE"
    return f"coalesce({known}, {'true' if node[2] else 'false'})"


def tree_sql(model: Model, tree: list, column, leaf=lambda path, tree: repr(tree[path[-1]][5])) -> str:
    """leaf(nodes on the way, tree) of the leaf that a row comes to."""

    def at(path: list[int]) -> str:
        node = tree[path[-1]]
        if node[0] < 0:
            return leaf(path, tree)
        return f"CASE WHEN {_goes_left(model, node, column)} THEN {at([*path, int(node[3])])} ELSE {at([*path, int(node[4])])} END"

    return at([0])


def score_sql(model: Model, column=lambda c: f'CAST("{c}" AS DOUBLE)') -> str:
    return " + ".join([f"{model.base}::DOUBLE", *(tree_sql(model, t, column) for t in model.trees)])


def _number(c: str) -> str:
    return f'CAST("{c}" AS DOUBLE)'


#: Features of the families' rows and of the clients, as the family features have them.
FAMILY = sorted({*BLOCK, *CROSS} - {"client_id", "family", "family_id"})
OWN = sorted({*FAMILY, *CLIENT})
RANKER = stored_model([c for c in OWN if c not in features.EXPERIMENTAL], "binary")
GATE = stored_model(sorted([f"{f}__{c}" for f in C.FAMILIES for c in FAMILY[::6]] + list(CLIENT[::2])), "binary")
SUMMARY = ("x_max_prob", "x_max_n", "x_min_next", "x_n_fam", "x_max_active")
LISTWISE = stored_model(sorted([*(c for c in OWN if c not in features.EXPERIMENTAL), *SUMMARY, "family_id"]), "softmax")

_ROWS = {
    "frow": f"SELECT client_id, family, family_id, {', '.join(_number(c) + f' AS "{c}"' for c in OWN)} FROM feat",
    "fscore": f"SELECT client_id, family, 1 / (1 + exp(-({score_sql(RANKER)}))) AS s FROM frow",
    "wrow": "SELECT client_id, " + ", ".join(f'any_value("{c}") AS "{c}"' if c in CLIENT else f'max("{c.split("__")[1]}") FILTER (family = \'{c.split("__")[0]}\') AS "{c}"' for c in GATE.features) + " FROM frow GROUP BY client_id",
    "gscore": f"SELECT client_id, 1 / (1 + exp(-({score_sql(GATE)}))) AS none FROM wrow",
    "crow": f"""SELECT * FROM (SELECT client_id, family, CAST(family_id AS DOUBLE) AS family_id, {', '.join(f'"{c}"' for c in OWN)} FROM frow
      UNION ALL SELECT client_id, 'none', 7.0, {', '.join(f'any_value("{c}")' if c in CLIENT else 'NULL' for c in OWN)} FROM frow GROUP BY client_id)
      JOIN (SELECT client_id, max(p_prob) AS x_max_prob, max(p_n) AS x_max_n, min(p_next) AS x_min_next, CAST(count(*) FILTER (n_streams > 0) AS DOUBLE) AS x_n_fam, max(n_active) AS x_max_active FROM frow GROUP BY client_id) USING (client_id)""",
    "cscore": f"SELECT *, {score_sql(LISTWISE)} AS s FROM crow",
    "csoft": "SELECT client_id, family, e / sum(e) OVER (PARTITION BY client_id) AS p FROM (SELECT client_id, family, exp(s - max(s) OVER (PARTITION BY client_id)) AS e FROM cscore)",
    "cwide": f"SELECT client_id, {', '.join(f"max(p) FILTER (family = '{c}') AS {c}" for c in C.CLASSES)} FROM csoft GROUP BY client_id",
}
_SHARES = ", ".join(f"round(max(s / total) FILTER (family = '{f}') * (1 - any_value(none)), 6) AS {f}" for f in C.FAMILIES)


@query(sql(f"SELECT client_id, {_SHARES}, round(any_value(none), 6) AS none FROM (SELECT *, sum(s) OVER (PARTITION BY client_id) AS total FROM fscore) JOIN gscore USING (client_id) GROUP BY client_id", _ROWS))
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of a stored ranker and none gate."""
    return rounded(models.predict_ranker(models.Bundle([RANKER], [GATE], ()), all_features(spark, sf_dir)), ("client_id",), C.CLASSES)


def _chances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = validate.check_candidates(features.candidate_rows(all_features(spark, sf_dir)))
    return rows, models.predict_listwise([LISTWISE], rows)


@query(sql(f"SELECT client_id, {', '.join(f'round({c}, 6) AS {c}' for c in C.CLASSES)} FROM cwide", _ROWS))
def listwise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of a stored listwise model over each client's eight candidates."""
    return rounded(_chances(spark, sf_dir)[1], ("client_id",), C.CLASSES)


@query(sql("SELECT count(DISTINCT client_id) AS n_clients, count(DISTINCT client_id) FILTER (family = 'gym') AS n_incomplete, 0 AS n_bad_candidate FROM crow", _ROWS))
def candidate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that are checked lack one class, so that the check has something to find."""
    return validate.candidate_violations(features.candidate_rows(all_features(spark, sf_dir)).where("family <> 'gym'"))


def _gains(model: Model) -> list[tuple[str, float]]:
    return [(model.features[int(n[0])], n[6]) for t in model.trees for n in t if n[0] >= 0]


_GROUP = """CASE WHEN contains(f, 'gap_last') OR contains(f, 'gap_max') OR contains(f, 'skipped_cycle') OR contains(f, 'amt_change_last') THEN 'ordered_sequence' WHEN contains(f, 'ref') OR contains(f, 'refund') THEN 'refunds'
  WHEN regexp_matches(f, 'next|last|first|span|per|overdue|active|due') THEN 'timing' WHEN regexp_matches(f, 'prob|mcc|generic|amt|family_id|odd_cur') THEN 'merchant_evidence' WHEN contains(f, 'c_') OR contains(f, 'n_streams') THEN 'background' ELSE 'other' END"""
_NODES = {"nodes": "SELECT * FROM (VALUES " + ", ".join(f"({m}, '{f}', {g}::DOUBLE)" for m, model in enumerate((RANKER, LISTWISE)) for f, g in _gains(model)) + ") v(m, f, g)"}


@query(sql(f"SELECT f AS feature, {_GROUP} AS feature_group, round(sum(g / total) / 2, 6) AS gain FROM (SELECT *, sum(g) OVER (PARTITION BY m) AS total FROM nodes) GROUP BY f", _NODES))
def gain_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of two stored models by feature, averaged."""
    return rounded(models.gain_importance([RANKER, LISTWISE], spark), ("feature", "feature_group"), ("gain",))


def _path_sql(path: list[int], tree: list) -> str:
    """What each split on the way changed, as a list of (feature, value)."""
    steps = [(LISTWISE.features[int(tree[a][0])], tree[b][5] - tree[a][5]) for a, b in zip(path, path[1:], strict=False)]
    return "[" + ", ".join(f"{{f: '{f}', v: {v!r}::DOUBLE}}" for f, v in steps) + "]"


_EXPLAINED = _ROWS | {
    "picked": f"SELECT client_id FROM (SELECT client_id FROM cwide ORDER BY round(greatest({', '.join(C.FAMILIES)}), 12) DESC, client_id LIMIT 1) UNION SELECT client_id FROM (SELECT client_id FROM cwide ORDER BY round(none, 12) DESC, client_id LIMIT 1)",
    "moved": "SELECT client_id, family_id, u.f AS feature, u.v AS v FROM (SELECT client_id, family_id, unnest(list_concat(" + ", ".join(tree_sql(LISTWISE, t, _number, _path_sql) for t in LISTWISE.trees) + ")) AS u FROM crow WHERE client_id IN (SELECT client_id FROM picked))",
    "parts": "SELECT client_id, family_id, feature, sum(v) AS v FROM moved GROUP BY ALL HAVING abs(sum(v)) > 1e-12",
}


@query(sql("SELECT client_id, CAST(family_id AS INT) AS family_id, feature, CAST(place AS INT) AS place, round(v, 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY client_id, family_id ORDER BY round(abs(v), 9) DESC, feature) AS place FROM parts) WHERE place <= 10", _EXPLAINED))
def local_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest contributions in a stored model for the client with the surest family and that with the surest none."""
    rows, chances = _chances(spark, sf_dir)
    return rounded(models.local_explanations(LISTWISE, rows, chances), ("client_id", "family_id", "feature", "place"), ("contribution",))


#: Inputs of the keyword stack's first stage, as the queries of the keyword stack have them.
KEYWORD = stored_model(["f_n", "f_last", "f_due", "f_n90", "oth_max_n", "due_minus_oth_min"], "binary")
STAGE_TWO = logistic.Model(
    [*(f"logit_{f}" for f in C.FAMILIES), "top1", "top2", "margin"], C.CLASSES,
    [[((3 * i + 5 * j) % 11 - 5) / 10 for j in range(len(C.FAMILIES) + 3)] for i in range(len(C.CLASSES))], [(i % 3 - 1) / 4 for i in range(len(C.CLASSES))],
)


_LOGITS = [f"logit_{f}" for f in C.FAMILIES]
_KEYWORD = _T | {
    "kx": "SELECT kl.client_id, kl.fam, kl.n AS f_n, kl.last AS f_last, kl.due AS f_due, kl.n90 AS f_n90, kr.oth_max_n, kr.due_minus_oth_min FROM kl JOIN kr USING (client_id, fam)",
    "kp": f"SELECT client_id, fam, least(greatest(1 / (1 + exp(-({score_sql(KEYWORD)}))), 0.0001::DOUBLE), 0.9999::DOUBLE) AS p FROM kx",
    "kw": f"SELECT client_id, {', '.join(f"max(ln(p / (1 - p))) FILTER (fam = '{f}') AS logit_{f}" for f in C.FAMILIES)} FROM kp GROUP BY client_id",
    "k2": f"SELECT *, list_reverse_sort([{', '.join(_LOGITS)}])[1] AS top1, list_reverse_sort([{', '.join(_LOGITS)}])[2] AS top2, list_reverse_sort([{', '.join(_LOGITS)}])[1] - list_reverse_sort([{', '.join(_LOGITS)}])[2] AS margin FROM kw",
    "k3": "SELECT client_id, " + ", ".join(f"exp({o}::DOUBLE + {' + '.join(f'{n} * ({w}::DOUBLE)' for n, w in zip(STAGE_TWO.names, ws, strict=True))}) AS {c}" for c, ws, o in zip(C.CLASSES, STAGE_TWO.weights, STAGE_TWO.offsets, strict=True)) + " FROM k2",
}


@query(sql(f"SELECT client_id, {', '.join(f'round({c} / ({" + ".join(C.CLASSES)}), 6) AS {c}' for c in C.CLASSES)} FROM k3", _KEYWORD))
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of a stored first stage and its logistic second stage."""
    rows, _, lines = _lines(spark, sf_dir)
    long = keyword.families_long(rows.select("client_id").distinct(), lines)
    return rounded(models.predict_keyword(([KEYWORD], STAGE_TWO), long), ("client_id",), C.CLASSES)
