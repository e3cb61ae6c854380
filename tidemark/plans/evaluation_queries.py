"""Queries of splits, decisions, metrics, rules, validation between tables and bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.operators import metrics, splits, validate
from tidemark.plans.oracle import digits, each, sql, uniform
from tidemark.plans.parser_queries import all_features
from tidemark.plans.registry import query, rounded
from tidemark.sources import adapters


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.clients(adapters.transactions(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str, seed: int = 0) -> DataFrame:
    people = _people(spark, sf_dir)
    return people.join(metrics.argmax_labels(adapters.scores(people, seed)), "client_id").select("client_id", F.col("label").alias("truth"), "prediction")


_CLASSES = "[" + each("'{f}'", C.CLASSES) + "]"


def _tables(seed: int) -> dict[str, str]:
    """Chances p<seed>, decisions a<seed> and pairs m<seed> for DuckDB."""
    raw = each(f"{uniform(seed, "client_id || ':{f}'", 'p')} + CASE WHEN label = '{{f}}' THEN 0.5 ELSE 0 END AS {{f}}".replace("{{f}}", "{f}"), C.CLASSES)
    total = " + ".join(C.CLASSES)
    return {
        f"p{seed}": f"SELECT client_id, {', '.join(f'{c} / ({total}) AS {c}' for c in C.CLASSES)} FROM (SELECT client_id, {raw} FROM lab)",
        f"a{seed}": f"SELECT client_id, {_CLASSES}[list_position([{', '.join(C.CLASSES)}], greatest({', '.join(C.CLASSES)}))] AS prediction FROM p{seed}",
        f"m{seed}": f"SELECT client_id, label AS truth, prediction FROM lab JOIN a{seed} USING (client_id)",
    }


_MORE = _tables(0) | _tables(1) | _tables(2) | {
    "classes": f"SELECT c, CAST(i AS INT) AS i FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(C.CLASSES))}) v(c, i)",
    "f1": "SELECT c AS label, count(*) FILTER (truth = c) AS support, CASE WHEN count(*) FILTER (truth = c) + count(*) FILTER (prediction = c) = 0 THEN 0 ELSE 2.0 * count(*) FILTER (truth = c AND prediction = c) / (count(*) FILTER (truth = c) + count(*) FILTER (prediction = c)) END AS f1 FROM m0, classes GROUP BY c",
    "dev": f"SELECT client_id, label, split = 'valid' AS is_valid, CASE WHEN split = 'valid' AND {digits('client_id')} % 5 = 0 THEN 'lockbox' ELSE 'development' END AS part FROM lab JOIN split USING (client_id) WHERE split IN ('train', 'valid')",
    "runs": " UNION ALL ".join(f"SELECT client_id, {s} AS seed, CAST({digits(f"'{s}:' || client_id")} % 5 AS INT) AS fold, is_valid, label AS truth, prediction FROM dev JOIN a{s} USING (client_id) WHERE part = 'development'" for s in range(3)),
    "views": "SELECT seed, 'pooled' AS view, -1 AS fold, truth, prediction FROM runs UNION ALL SELECT seed, 'pooled', fold, truth, prediction FROM runs UNION ALL SELECT seed, CASE WHEN is_valid THEN 'valid' ELSE 'train' END, -1, truth, prediction FROM runs",
    "twin": "SELECT truth, m0.prediction AS first, a1.prediction AS second FROM m0 JOIN a1 USING (client_id)",
    "cells": "SELECT *, sum(n) OVER (ORDER BY truth, first, second) AS stop, sum(n) OVER (ORDER BY truth, first, second) - n AS start FROM (SELECT truth, first, second, count(*) AS n FROM twin GROUP BY ALL)",
}


def _boot(seed: int, samples: int) -> dict[str, str]:
    u = uniform(seed, "(CAST(sample AS VARCHAR) || ':' || CAST(draw AS VARCHAR))", "boot")
    return {
        "drawn": f"SELECT sample, floor({u} * total) AS place FROM (SELECT sample, unnest(range(total)) AS draw, total FROM range({samples}) s(sample), (SELECT count(*) AS total FROM twin))",
        "weights": "SELECT sample, truth, first, second, count(*) AS w FROM drawn JOIN cells ON place >= start AND place < stop GROUP BY ALL",
        "marks": "SELECT sample, 0 AS r, truth, first AS prediction, w FROM weights UNION ALL SELECT sample, 1, truth, second, w FROM weights",
        "bf": "SELECT sample, r, sum(f) / 8 AS f FROM (SELECT sample, r, c, coalesce(2.0 * sum(w) FILTER (truth = c AND prediction = c) / nullif(coalesce(sum(w) FILTER (truth = c), 0) + coalesce(sum(w) FILTER (prediction = c), 0), 0), 0) AS f FROM marks, classes GROUP BY ALL) GROUP BY sample, r",
    }


@query(sql(f"SELECT client_id, {digits('client_id')} % 5 = 0 AS lockbox, {each(f"CAST({digits("'{f}:' || client_id")} % 5 AS INT) AS fold_{{f}}".replace("{{f}}", "{f}"), (0, 1, 2))} FROM (SELECT DISTINCT client_id FROM txn)"))
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(_people(spark, sf_dir))


@query(sql("SELECT * FROM dev", _MORE))
def lockbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.development(_people(spark, sf_dir))


@query(sql(f"SELECT client_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {uniform(0, 'client_id', 'fold')}, client_id) - 1) % 5 AS INT) AS fold FROM lab"))
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(_people(spark, sf_dir))


@query(sql("SELECT 0 AS n_missing, 0 AS n_extra, count(*) FILTER (fold <> 0) AS n_wrong FROM runs WHERE seed = 0", _MORE))
def fold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds that are checked are all 0, so that the check has something to find."""
    people = _people(spark, sf_dir)
    given = splits.development(people).where("part = 'development'").select("client_id", F.lit(0).alias("fold"))
    return splits.fold_violations(given, people, 0)


@query(sql("SELECT a.split AS first, b.split AS second, 0 AS n_shared FROM (SELECT DISTINCT split FROM split) a JOIN (SELECT DISTINCT split FROM split) b ON a.split < b.split"))
def split_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.split_overlaps(_people(spark, sf_dir))


@query(sql("SELECT count(*) FILTER (label = 'none') AS n_left_only, 0 AS n_right_only, 0 AS n_repeated, 0 AS n_null FROM lab"))
def key_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    return validate.key_mismatches(people, people.where(F.col("label") != C.NONE))


@query(sql("SELECT count(*) AS n_rows, 0 AS n_null, count(*) FILTER (split = 'test') AS n_bad_cutoff, 0 AS n_bad_label, 0 AS n_repeated FROM split"))
def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).withColumn("cutoff_date", F.when(F.col("split") == "test", "2024-03-01").otherwise("2024-02-01"))
    return validate.label_violations(rows, "2024-02-01")


@query(sql("SELECT client_id, prediction FROM a0", _MORE))
def argmax_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.argmax_labels(adapters.scores(_people(spark, sf_dir), 0))


@query(sql(f"SELECT client_id, {', '.join(f'round(0.25 * p0.{c} + 0.75 * p1.{c}, 6) AS {c}' for c in C.CLASSES)} FROM p0 JOIN p1 USING (client_id)", _MORE))
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    tables = {"a": adapters.scores(people, 0), "b": adapters.scores(people, 1)}
    return rounded(metrics.blend(tables, {"a": 1.0, "b": 3.0, "absent": 5.0, "c": 0.0}), ("client_id",), C.CLASSES)


@query(sql(f"SELECT client_id, {', '.join(f'round({c} * {0.8 if c == C.NONE else 1.0} / (1 - 0.2 * none), 6) AS {c}' for c in C.CLASSES)} FROM p0", _MORE))
def none_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.adjust_none(adapters.scores(_people(spark, sf_dir), 0)), ("client_id",), C.CLASSES)


_SEED = lambda s: f"SELECT p{s}.client_id, {', '.join(f'p{s}.{c} / ({" + ".join(f'p{s}.{x}' for x in C.FAMILIES)}) * (1 - p2.none) AS {c}' for c in C.FAMILIES)}, p2.none FROM p{s} JOIN p2 ON p2.client_id = p{s}.client_id"


@query(sql(f"SELECT client_id, {', '.join(f'round(avg({c}), 6) AS {c}' for c in C.CLASSES)} FROM ({_SEED(0)} UNION ALL {_SEED(1)}) GROUP BY client_id", _MORE))
def predict_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    rows = [adapters.scores(people, s).unpivot("client_id", list(C.FAMILIES), "family", "score").withColumn("seed", F.lit(s)) for s in (0, 1)]
    none = adapters.scores(people, 2).select("client_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed"), F.col(C.NONE).alias("p_none"))
    return rounded(metrics.from_scores(rows[0].unionByName(rows[1]), none), ("client_id",), C.CLASSES)


@query(sql("""SELECT client_id, family, round(e / z, 6) AS p, round(e / z - y, 6) AS grad, round(e / z * (1 - e / z) + 1e-6, 6) AS hess FROM (SELECT client_id, family, exp(s) AS e, sum(exp(s)) OVER (PARTITION BY client_id) AS z, CAST(family = label AS INT) AS y
FROM (SELECT client_id, UNNEST([""" + each("'{f}'", C.CLASSES) + "]) AS family, UNNEST([" + ", ".join(C.CLASSES) + "]) AS s FROM p0) JOIN lab USING (client_id))", _MORE))  # fmt: skip
def softmax_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    rows = adapters.scores(people, 0).unpivot("client_id", list(C.CLASSES), "family", "score").join(people.select("client_id", "label"), "client_id")
    rows = rows.withColumn("y", (F.col("family") == F.col("label")).cast("int"))
    return rounded(metrics.softmax_gradient(rows), ("client_id", "family"), ("p", "grad", "hess"))


@query(sql("SELECT t.c AS truth, p.c AS prediction, count(m0.truth) AS n FROM classes t CROSS JOIN classes p LEFT JOIN m0 ON truth = t.c AND prediction = p.c GROUP BY ALL", _MORE))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_pairs(spark, sf_dir))


@query(sql("SELECT label, support, round(f1, 6) AS f1 FROM f1", _MORE))
def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_f1(_pairs(spark, sf_dir)), ("label", "support"), ("f1",))


@query(sql("SELECT round(sum(f1) / 8, 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS n FROM f1", _MORE))
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.macro_f1(_pairs(spark, sf_dir)), ("n",), ("macro_f1",))


@query(sql("SELECT round(avg(CAST(truth = prediction AS INT)), 6) AS accuracy FROM m0", _MORE))
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.accuracy(_pairs(spark, sf_dir)), (), ("accuracy",))


@query(sql("SELECT round(avg(CASE WHEN a.none > b.none THEN 1.0 WHEN a.none = b.none THEN 0.5 ELSE 0 END), 6) AS auc FROM (SELECT none FROM p0 JOIN lab USING (client_id) WHERE label = 'none') a, (SELECT none FROM p0 JOIN lab USING (client_id) WHERE label <> 'none') b", _MORE))
def none_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    rows = adapters.scores(people, 0).join(people, "client_id").select(F.col(C.NONE).alias("p"), (F.col("label") == C.NONE).cast("int").alias("y"))
    return rounded(metrics.auc(rows), (), ("auc",))


@query(sql("""SELECT seed, view, fold, n, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM (SELECT seed, view, fold, sum(f) / 8 AS macro_f1 FROM (SELECT seed, view, fold, c, coalesce(2.0 * count(*) FILTER (truth = c AND prediction = c) / nullif(count(*) FILTER (truth = c) + count(*) FILTER (prediction = c), 0), 0) AS f
FROM views, classes GROUP BY ALL) GROUP BY ALL) JOIN (SELECT seed, view, fold, count(*) AS n, avg(CAST(truth = prediction AS INT)) AS accuracy FROM views GROUP BY ALL) USING (seed, view, fold)""", _MORE))  # fmt: skip
def score_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    dev = splits.development(people).where("part = 'development'")
    runs = None
    for seed in range(3):
        found = metrics.argmax_labels(adapters.scores(people, seed))
        run = dev.join(found, "client_id").select(F.lit(seed).alias("seed"), splits.fold_of(seed, F.col("client_id")).alias("fold"), "is_valid", F.col("label").alias("truth"), "prediction")
        runs = run if runs is None else runs.unionByName(run)
    return rounded(metrics.score_repetitions(runs), ("seed", "view", "fold", "n"), ("macro_f1", "accuracy"))


@query(sql("SELECT CAST(row_number() OVER (ORDER BY client_id DESC) - 1 AS BIGINT) AS pos, client_id, prediction AS predicted_next_recurring_merchant FROM split JOIN a0 USING (client_id) WHERE split = 'test'", _MORE))
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    order = metrics.Window.partitionBy(F.lit(0)).orderBy(F.desc("client_id"))
    sample = people.where("split = 'test'").select((F.row_number().over(order) - 1).cast("long").alias("pos"), "client_id")
    return metrics.submission(adapters.scores(people, 0), sample)


_PICK = "(SELECT client_id, family AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {order}, family_id) AS rn FROM feat WHERE {cond}) WHERE rn = 1)"
_ON, _LONE = "p_active = 1 AND p_prob >= 0.4", "s_prob >= 0.5 AND s_last >= -45"
_RULE_SQL = (
    "FROM lab LEFT JOIN "
    + " LEFT JOIN ".join(
        _PICK.format(name=n, order=o, cond=c) + f" {n} USING (client_id)"
        for n, o, c in (("earliest", "p_next", _ON), ("most", "p_n DESC, p_next", _ON), ("recent", "p_last DESC, p_next", _ON), ("single", "s_last DESC", _LONE))
    )
    + " LEFT JOIN cfull USING (client_id)"
)


def _rules(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return metrics.rules(all_features(spark, sf_dir), _people(spark, sf_dir)).select("client_id", F.col(column).alias("prediction"))


@query(sql(f"SELECT client_id, coalesce(earliest, single, 'none') AS prediction {_RULE_SQL}"))
def rule_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir, "earliest_next")


@query(sql(f"SELECT client_id, coalesce(most, single, 'none') AS prediction {_RULE_SQL}"))
def rule_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir, "most_payments")


@query(sql(f"SELECT client_id, coalesce(recent, single, 'none') AS prediction {_RULE_SQL}"))
def rule_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir, "most_recent")


@query(sql(f"SELECT client_id, CASE WHEN c_n_active_ref + c_n_ended_ref >= 2 THEN 'none' ELSE coalesce(earliest, single, 'none') END AS prediction {_RULE_SQL}"))
def rule_r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir, "refunded_none")


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    found = [metrics.argmax_labels(adapters.scores(people, s)).withColumnRenamed("prediction", n) for s, n in ((0, "first"), (1, "second"))]
    return people.join(found[0], "client_id").join(found[1], "client_id").select(F.col("label").alias("truth"), "first", "second")


SAMPLES = C.BOOTSTRAP_SAMPLES


@query(sql("SELECT round(quantile_cont(f, 0.025), 6) AS lower, round(quantile_cont(f, 0.975), 6) AS upper, count(*) AS samples FROM (SELECT sample, avg(f) AS f FROM bf GROUP BY sample)", _MORE | _boot(C.BOOTSTRAP_SEED, SAMPLES)))
def bootstrap_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.interval(metrics.bootstrap(_two(spark, sf_dir), ["first", "second"], SAMPLES)), ("samples",), ("lower", "upper"))


@query(sql("SELECT round(quantile_cont(d, 0.025), 6) AS lower, round(quantile_cont(d, 0.975), 6) AS upper, count(*) AS samples FROM (SELECT sample, max(f) FILTER (r = 1) - max(f) FILTER (r = 0) AS d FROM bf GROUP BY sample)", _MORE | _boot(2028, SAMPLES)))
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.interval(metrics.paired_difference(_two(spark, sf_dir), "first", "second", SAMPLES), "difference"), ("samples",), ("lower", "upper"))




_CLASS_BOOT = _MORE | _boot(C.BOOTSTRAP_SEED, SAMPLES) | {
    "cf": "SELECT sample, c AS label, coalesce(2.0 * sum(w) FILTER (truth = c AND prediction = c) / nullif(coalesce(sum(w) FILTER (truth = c), 0) + coalesce(sum(w) FILTER (prediction = c), 0), 0), 0) AS f FROM marks, classes WHERE r = 0 GROUP BY ALL",
    "cells": "SELECT *, sum(n) OVER (ORDER BY truth, first) AS stop, sum(n) OVER (ORDER BY truth, first) - n AS start FROM (SELECT truth, first, '' AS second, count(*) AS n FROM twin GROUP BY ALL)",
}


@query(sql("SELECT label, round(quantile_cont(f, 0.025), 6) AS lower, round(quantile_cont(f, 0.975), 6) AS upper FROM cf GROUP BY label", _CLASS_BOOT))
def bootstrap_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each class' F1."""
    return rounded(metrics.class_intervals(_two(spark, sf_dir).select("truth", "first"), "first", SAMPLES), ("label",), ("lower", "upper"))
