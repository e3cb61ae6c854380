from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.operators import features, grammar, prior, streams


def named(spark, texts):
    return {r["description"]: r for r in grammar.evidence(grammar.parse(spark.createDataFrame([(t,) for t in texts], "description string"))).collect()}


def test_every_base_name_reads_back_whole_and_affixed(spark):
    """Each known name alone, with one prefix and one suffix, and shortened by abbreviation, from the vocabulary itself."""
    bases = [n for f in C.FAMILIES for n in C.FAMILY_NAMES[f]][:12]
    rows = named(spark, [t for b in bases for t in (b, f"{C.PREFIXES[0]} {b}", f"{b} {C.SUFFIXES[0]}")])
    for b in bases:
        assert (rows[b]["stripped"], rows[b]["exact"]) == (0, True) and b in rows[b]["bases"]
        assert rows[f"{C.PREFIXES[0]} {b}"]["stripped"] == 1 and rows[f"{b} {C.SUFFIXES[0]}"]["stripped"] == 1


def test_unknown_and_empty_descriptions_have_no_base(spark):
    rows = named(spark, ["qqq zzz", "", " "])
    assert all(r["bases"] == [] and r["stripped"] == 99 and not r["exact"] for r in rows.values())


def test_family_evidence_is_a_distribution_over_the_bases_families(spark):
    names = sorted({n for f in C.FAMILIES for n in C.FAMILY_NAMES[f]})
    for text, r in named(spark, names).items():
        own = [f for f in C.FAMILIES if text in C.FAMILY_NAMES[f]]
        assert r["kind"] == "fam"
        assert sum(r[f"d_{f}"] for f in C.FAMILIES) == pytest.approx(1.0)
        assert {f for f in C.FAMILIES if r[f"d_{f}"] > 0} >= set(own)


def payments(spark, amounts, days, description="urban gym", mcc="7997", kind="card_payment"):
    base = dt.datetime(2026, 1, 1)
    rows = [(i, "C1", base + dt.timedelta(days=d), float(a), "chf", "out", kind, mcc, description, 0.0, d) for i, (a, d) in enumerate(zip(amounts, days, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, client_id string, timestamp timestamp, amount double, currency string, direction string, type string, mcc string, description string, fee double, day int")
    return df.withColumn("date", F.to_date("timestamp"))


def test_islands_follow_gaps_above_the_tolerance(spark):
    """Steps of 2 % keep an island together however far it drifts; one of 5 % parts it."""
    amounts = [40 * 1.02**i for i in range(8)]
    amounts += [amounts[-1] * 1.05 * 1.01**i for i in range(5)]
    df = payments(spark, amounts[::-1], range(-200, -200 + 13 * 9, 9))
    sizes = [r["n"] for r in streams.islands(df).groupBy("sid").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [5, 8]


def test_records_count_refunds_in_the_band_and_the_days(spark):
    """Of refunds after the third of five payments only those within 3 % and ten days count; the last payment has none."""
    paid = payments(spark, [24.0] * 5, [-150, -119, -88, -57, -26])
    back = payments(spark, [24.5, 24.9, 23.4, 24.0], [-80, -81, -70, -10], kind="refund").withColumn("row_id", F.col("row_id") + 100)
    rows = grammar.described(paid.unionByName(back))
    flat = spark.range(C.PRIOR_BINS).select(F.col("id").cast("int").alias("bin"), *(F.lit(0.0).alias(f"logp_{f}") for f in C.FAMILIES))
    r = streams.stream_records(rows, flat).first()
    assert (r["n"], r["per"], r["nref"], r["last_refunded"]) == (5, 31.0, 1, 0.0)
    assert r["last_ref"] == -80 and sum(r[f"post_{f}"] for f in C.FAMILIES) == pytest.approx(1.0)


def test_zero_period_counts_as_thirty_days_for_next_only(spark):
    rows = grammar.described(payments(spark, [20.0, 20.0], [-5, -5]))
    learned = prior.amount_prior(rows)
    made = features.build_features(rows, streams.stream_records(rows, prior.wide(learned)), learned).where("family = 'gym'").first()
    assert (made["p_per"], made["p_next"], made["earliest_plausible_next"], made["c_min_next"]) == (30.0, 25.0, -5.0, -5.0)


def test_prior_bins(spark):
    edges = [1.5 * (800 / 1.5) ** (i / 40) for i in range(41)]
    df = spark.createDataFrame([(1.0,), (edges[3] * 1.0001,), (900.0,)], "a double").select(streams.amount_bin(F.col("a")).alias("b"))
    assert [r["b"] for r in df.collect()] == [0, 3, 39]


def test_feature_groups():
    found = [features.feature_group(c) for c in ("p_gap_last1", "c_refunds_30", "p_next", "p_prob", "c_rows", "e")]
    assert found == ["ordered_sequence", "refunds", "timing", "merchant_evidence", "background", "other"]
