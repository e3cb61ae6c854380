from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.functions.hashing import fold_of, is_lockbox
from tidemark.operators import metrics, splits, validate


def chances(spark, rows):
    return spark.createDataFrame([(k, *(float(v.get(c, 0)) for c in C.CLASSES)) for k, v in rows.items()], "client_id string, " + ", ".join(f"{c} double" for c in C.CLASSES))


def test_f1_by_class_against_a_plain_count(spark):
    """Seven classes of which two are never true and one is never predicted."""
    truth = [C.CLASSES[i % 5] for i in range(40)]
    guess = [C.CLASSES[(i * i) % 6] for i in range(40)]
    found = {r["label"]: r["f1"] for r in metrics.class_f1(spark.createDataFrame(list(zip(truth, guess, strict=True)), "truth string, prediction string")).collect()}
    for c in C.CLASSES:
        hit = sum(t == g == c for t, g in zip(truth, guess, strict=True))
        n = truth.count(c) + guess.count(c)
        assert found[c] == pytest.approx(2 * hit / n if n else 0.0)
    assert metrics.macro_f1(spark.createDataFrame(list(zip(truth, guess, strict=True)), "truth string, prediction string")).first()["macro_f1"] == pytest.approx(sum(found.values()) / len(C.CLASSES))


def test_blend_weighs_tables_that_are_there(spark):
    """Three tables, one of weight 0 and one that is not there: the mean of the others by weight, class by class."""
    one = {f"K{i}": {c: (1 + (i + j) % 4) / 20 for j, c in enumerate(C.CLASSES)} for i in range(5)}
    two = {f"K{i}": {c: (1 + (i * j) % 3) / 16 for j, c in enumerate(C.CLASSES)} for i in range(5)}
    tables = {"one": chances(spark, one), "two": chances(spark, two), "idle": chances(spark, {k: {"gym": 1.0} for k in one})}
    for r in metrics.blend(tables, {"one": 2.0, "two": 0.5, "idle": 0.0, "gone": 9.0}).collect():
        for c in C.CLASSES:
            assert r[c] == pytest.approx((2.0 * one[r["client_id"]][c] + 0.5 * two[r["client_id"]][c]) / 2.5)
    with pytest.raises(ValueError, match="positive"):
        metrics.blend(tables, {"idle": 0.0, "gone": 1.0})


def test_equal_chances_go_to_the_first_class(spark):
    even = chances(spark, {"K": {c: 0.125 for c in C.CLASSES}, "L": {C.CLASSES[3]: 0.5, C.CLASSES[6]: 0.5}})
    assert {r["client_id"]: r["prediction"] for r in metrics.argmax_labels(even).collect()} == {"K": C.CLASSES[0], "L": C.CLASSES[3]}


def test_auc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "p double, y int")
    assert metrics.auc(df).first()["auc"] == pytest.approx(0.875)


def test_splits_are_those_of_the_digest(spark):
    """Lockbox and folds of made-up clients, recomputed from their digests; train clients are never locked."""
    rows = [(f"client-{7 * i}", ("train", "valid", "test")[i % 3], C.CLASSES[i % 8]) for i in range(90)]
    people = spark.createDataFrame(rows, "client_id string, split string, label string")
    rest = lambda t: int.from_bytes(hashlib.sha256(t.encode()).digest(), "big") % 5
    for r in people.select("client_id", is_lockbox(F.col("client_id")).alias("locked"), fold_of(31, F.col("client_id")).alias("fold")).collect():
        assert (r["locked"], r["fold"]) == (rest(r["client_id"]) == 0, rest("31:" + r["client_id"]))
    parts = {r["client_id"]: r["part"] for r in splits.development(people).collect()}
    assert parts == {i: "lockbox" if s == "valid" and rest(i) == 0 else "development" for i, s, _ in rows if s != "test"}


def test_bootstrap_interval_holds_the_point(spark):
    df = spark.createDataFrame([(C.CLASSES[i % 8], C.CLASSES[i % 8 if i % 3 else (i + 1) % 8]) for i in range(80)], "truth string, a string")
    point = metrics.macro_f1(df.withColumnRenamed("a", "prediction")).first()["macro_f1"]
    found = metrics.interval(metrics.bootstrap(df, ["a"], samples=100)).first()
    assert found["lower"] <= point <= found["upper"] and found["samples"] == 100


GOOD = {"client_id": "K7", "timestamp": dt.datetime(2025, 6, 3, 8, 30), "amount": 4.2, "currency": "eur", "direction": "in", "type": "refund", "mcc": "4899", "description": "some shop", "fee": 0.1}
SCHEMA = "client_id string, timestamp timestamp, amount double, currency string, direction string, type string, mcc string, description string, fee double"


@pytest.mark.parametrize(("change", "rule"), [({}, None), ({"timestamp": dt.datetime(2026, 1, 1)}, "n_future"), ({"amount": 0.0}, "n_bad_amount"), ({"amount": float("nan")}, "n_bad_amount"), ({"fee": -1.0}, "n_bad_fee"), ({"direction": "up"}, "n_bad_direction"), ({"mcc": None}, "n_null"), ({"client_id": ""}, "n_empty_id")])
def test_transactions(spark, change, rule):
    row = GOOD | change
    df = spark.createDataFrame([tuple(row[c] for c in GOOD)], SCHEMA)
    if rule is None:
        validate.check_transactions(df, "2026-01-01")
    else:
        with pytest.raises(validate.InvalidData, match=rule):
            validate.check_transactions(df, "2026-01-01")
    with pytest.raises(validate.InvalidData, match="columns"):
        validate.check_transactions(df.drop("fee"), "2026-01-01")


def test_submission_keeps_the_samples_order(spark):
    sample = spark.createDataFrame([(i, f"K{9 - i}") for i in range(6)], "pos long, client_id string")
    out = metrics.submission(chances(spark, {f"K{i}": {C.CLASSES[i % 8]: 0.7} for i in range(12)}), sample).orderBy("pos").collect()
    column = "predicted_next_recurring_merchant"
    assert [(r["client_id"], r[column]) for r in out] == [(f"K{9 - i}", C.CLASSES[(9 - i) % 8]) for i in range(6)]
    right = [(r["client_id"], r[column]) for r in out]
    broken = {"n_right_only": [*right[1:], ("K99", "gym")], "n_repeated": [*right, right[0]], "n_bad_label": [*right[1:], (right[0][0], "shoes")], "n_left_only": right[1:]}
    for rule, rows in broken.items():
        found = validate.submission_violations(spark.createDataFrame(rows, f"client_id string, {column} string"), sample).first()
        assert found[rule] == 1, rule


@pytest.mark.parametrize(("leaky", "safe", "right"), [(0.30, 0.70, True), (0.40, 0.55, True), (0.20, 0.54, False), (0.50, 0.60, False), (0.46, 0.60, False)])
def test_leak_contrast(leaky, safe, right):
    if right:
        validate.check_leak_contrast(leaky, safe)
    else:
        with pytest.raises(validate.InvalidData):
            validate.check_leak_contrast(leaky, safe)
