"""The listwise stack moves a client's rows once; what it computes from them stays there, and stays the same."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark import catalogue
from tidemark.functions import constants as C
from tidemark.operators import kernel

COLUMNS = "row_id long, client_id string, dayf double, amount double, currency string, type string, mcc string, description string"


def _rows():
    rng, out = random.Random(8), []
    for i in range(300):
        kind = rng.choice(["card_payment", "card_payment", "card_payment", "refund", "transfer"])
        f = rng.randrange(7)
        name = rng.choice([C.FAMILY_NAMES[C.FAMILIES[f]][0], C.EVERYDAY[0], C.GENERIC_SUBSCRIPTION[0]])
        out.append((i, f"C{rng.randrange(5)}", -rng.randrange(1, 400) / 2, rng.choice([9.9, 10.0, 10.5, 11.2, 30.0, 0.05]), rng.choice(["chf", "eur", None]), kind, str(rng.choice([5732, 7997, 5812, 1])), name))
    out.append((900, "only refunds", -3.0, 10.0, "chf", "refund", "7997", C.FAMILY_NAMES["gym"][0]))
    out.append((901, "no family", -4.0, 10.0, "chf", "transfer", "1", "x"))
    return out


def test_candidate_matrix_deals_by_client_once(spark):
    plan = catalogue.queries()["candidate_matrix"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(client_id") == 1
    assert plan.count("Join ") == 1 and plan.count("Scan parquet") == 2, "lines meet orders, and nothing else is joined or read"


def test_evidence_is_smoothed_over_all_pairs_of_similar_amounts(spark):
    df = spark.createDataFrame(_rows(), COLUMNS)
    rows = [r.asDict() for r in kernel.evidence(df).collect()]
    for got in kernel.assign_families(df).collect():
        own = next(r for r in rows if r["row_id"] == got["row_id"])
        near = [(math.exp(-0.5 * ((own["la"] - r["la"]) / 0.035) ** 2), r) for r in rows if own["eligible"] and r["eligible"] and r["client_id"] == own["client_id"] and abs(r["la"] - own["la"]) < 0.12]
        mass = max(sum(k for k, _ in near), 1)
        score = [round(own[f"e_{f}"] + 1.3 * sum(k * r[f"e_{f}"] for k, r in near) / mass, 9) for f in C.FAMILIES]
        assert abs(got["confidence"] - (max(score) if own["eligible"] else 0)) < 1e-8
        assert got["family"] == (score.index(max(score)) if own["eligible"] and max(score) >= 0.05 else -1)


def test_profile_carries_the_context_and_all_parts(spark):
    assigned = kernel.assign_families(spark.createDataFrame(_rows(), COLUMNS)).localCheckpoint()
    profile = kernel.family_profile(assigned, context=True).localCheckpoint()
    assert profile.count() == 7 * 7 and profile.select("client_id", "family").distinct().count() == 7 * 7
    context = {r["client_id"]: r.asDict() for r in kernel.client_context(assigned, profile).collect()}
    for r in profile.select("client_id", "context").collect():
        got = r["context"].asDict()
        assert got.keys() == context[r["client_id"]].keys() - {"client_id"}
        assert all(abs(float(v) - float(context[r["client_id"]][c])) < 1e-9 for c, v in got.items())
    payments = kernel.core_rows(assigned.where("type = 'card_payment' AND family >= 0"))
    rows = {(r["client_id"], r["family"]): r for r in profile.collect()}
    for prefix, part in (("", payments), ("core_", payments.where("core")), ("recentcore_", payments.where("recentcore"))):
        for r in kernel.stream_statistics(part).collect():
            own = rows[r["client_id"], r["family"]]
            assert all(own[f"{prefix}{c}"] == v or abs(own[f"{prefix}{c}"] - v) < 1e-9 for c, v in r.asDict().items() if c not in ("client_id", "family"))
    refunds = {(r["client_id"], r["family"]): r for r in assigned.where("type = 'refund' AND family >= 0").groupBy("client_id", "family").agg(F.count("*").alias("n"), (-F.max("dayf")).alias("age")).collect()}
    for r in profile.select("client_id", "family", "n", "refund_n", "refund_age").collect():
        found = refunds.get((r["client_id"], r["family"]))
        assert (r["refund_n"], r["refund_age"]) == ((found["n"], found["age"]) if found else (0, None)) and r["n"] is not None
    part = kernel.family_profile(assigned, C.JOINT)
    assert set(part.columns) == {"client_id", "family", *C.JOINT}
    for r in part.collect():
        assert all(rows[r["client_id"], r["family"]][c] == v for c, v in r.asDict().items())
