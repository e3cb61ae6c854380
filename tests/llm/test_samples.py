"""Bounded samples hold their bound and keep small groups."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common, language, quality


def test_quotas():
    assert common.quotas([300, 50_000, 50_000], 2400) == [300, 1050, 1050]
    assert common.quotas([1] * 10, 10) == [1] * 10
    assert common.quotas([5, 5], 100) == [5, 5]
    assert common.quotas([], 7) == []


def test_rare_groups_are_whole_and_the_bound_holds(spark):
    sizes = {f"l{i}": 20_000 for i in range(8)} | {"rare": 300, "one": 1}
    rows = spark.range(sum(sizes.values())).withColumn("at", F.col("id"))
    edges = np.cumsum([0, *sizes.values()]).tolist()
    group = F.lit(None).cast("string")
    for name, a, b in zip(sizes, edges, edges[1:], strict=False):
        group = F.when((F.col("id") >= a) & (F.col("id") < b), name).otherwise(group)
    kept = Counter(r["g"] for r in common.bounded_sample(rows.withColumn("g", group), "g", 2400, F.col("id")).collect())
    assert kept["one"] == 1 and kept["rare"] == 266 and sum(kept.values()) == 2400
    assert {kept[f"l{i}"] for i in range(8)} <= {266, 267}


def test_a_thousand_groups(spark):
    rows = spark.range(5000).withColumn("g", F.concat(F.lit("g"), (F.col("id") % 1000).cast("string")))
    kept = Counter(r["g"] for r in common.bounded_sample(rows, "g", 2400, F.col("id")).collect())
    assert len(kept) == 1000 and set(kept.values()) <= {2, 3} and sum(kept.values()) == 2400


def test_equal_rows_are_cut_to_the_bound(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("a").alias("g"))
    assert common.bounded_sample(rows, "g", 10, F.col("doc_id")).count() == 10
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    assert common.labelled_sample(rows, labels, "quality", 10).count() == 10
    assert quality.fit(rows, labels, 10).share == 0.5


def test_many_languages(spark):
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnop"]  # 320
    rows = [(10 * i + j + 1, f"{n * 3} {n[::-1]}x{n} " * 4, n) for i, n in enumerate(names) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) >= 315
    right = np.mean([model.predict(t)[0] == n for _, t, n in rows if n in model.languages])
    assert right > 0.8
