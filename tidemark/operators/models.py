"""The three model families: family ranker with a none gate, listwise softmax, and the keyword stack's two stages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.functions.hashing import fold_of
from tidemark.operators import boosting, features, keyword, logistic, metrics, validate
from tidemark.operators.boosting import Model, Settings

#: Settings of the four kinds of boosted model. Fixed values; 15 leaves are 4 levels.
RANKER = Settings("binary", rounds=400, rate=0.03, depth=4, l2=1.0, row_share=0.8, column_share=0.8)
SOFTMAX = Settings("softmax", rounds=400, rate=0.03, depth=4, l2=1.0, row_share=0.8, column_share=0.8)
KEYWORD = Settings("binary", rounds=450, rate=0.03, depth=4, l2=1.0, row_share=0.8, column_share=0.5)
LISTWISE = Settings("softmax", rounds=1000, rate=0.04, depth=5, l2=5.0)


def numbers(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    """Numeric feature columns, sorted."""
    skip = {"client_id", "family", "fam", "label", "target", *drop}
    return sorted(c for c, kind in df.dtypes if c not in skip and kind in ("int", "bigint", "double", "float"))


@dataclass
class Bundle:
    rankers: list[Model] = field(default_factory=list)
    gates: list[Model] = field(default_factory=list)
    drop: tuple[str, ...] = ()


def _wide(rows: DataFrame, drop: tuple[str, ...]) -> DataFrame:
    return features.wide_features(rows, drop).withColumn("family_id", F.lit(0))


def fit_ranker(rows: DataFrame, labels: DataFrame, drop: tuple[str, ...] = features.EXPERIMENTAL, seeds: tuple[int, ...] = (0, 1, 2), settings: Settings = RANKER) -> Bundle:
    """Rankers of families on the clients that have one, and gates for `none` on all; one of each for a seed."""
    known = rows.join(labels, "client_id")
    ranked = known.where(F.col("label") != C.NONE).withColumn("target", (F.col("family") == F.col("label")).cast("int"))
    gated = _wide(rows, drop).join(labels, "client_id").withColumn("target", (F.col("label") == C.NONE).cast("int"))
    bundle = Bundle(drop=tuple(drop))
    for seed in seeds:
        own = replace(settings, seed=seed)
        bundle.rankers.append(boosting.fit(ranked, numbers(ranked, drop), "target", own))
        bundle.gates.append(boosting.fit(gated, [c for c in numbers(gated) if c != "family_id"], "target", own))
    return bundle


def predict_ranker(bundle: Bundle, rows: DataFrame) -> DataFrame:
    scores = none = None
    sigmoid = 1 / (1 + F.exp(-F.col("score")))
    name = F.element_at(F.array(*map(F.lit, C.FAMILIES)), F.col("family_id") + 1)
    wide = _wide(rows, bundle.drop)
    for seed, (ranker, gate) in enumerate(zip(bundle.rankers, bundle.gates, strict=True)):
        s = boosting.predict(rows, ranker).select("client_id", F.lit(seed).alias("seed"), name.alias("family"), sigmoid.alias("score"))
        n = boosting.predict(wide, gate).select("client_id", F.lit(seed).alias("seed"), sigmoid.alias("p_none"))
        scores, none = (s, n) if scores is None else (scores.unionByName(s), none.unionByName(n))
    return metrics.from_scores(scores, none)


def fit_listwise(rows: DataFrame, labels: DataFrame, drop: tuple[str, ...] = features.EXPERIMENTAL, seeds: tuple[int, ...] = (0, 1, 2), settings: Settings = SOFTMAX) -> list[Model]:
    """rows: the eight candidates of each client."""
    validate.check_candidates(rows)
    known = rows.join(labels, "client_id").withColumn("target", (F.col("family") == F.col("label")).cast("int"))
    return [boosting.fit(known, numbers(rows, drop), "target", replace(settings, seed=s)) for s in seeds]


def predict_listwise(models: list[Model], rows: DataFrame) -> DataFrame:
    """Softmax over each client's candidates, averaged over the models."""
    name = F.element_at(F.array(*map(F.lit, C.CLASSES)), F.col("family_id") + 1)
    stacked = None
    for seed, model in enumerate(models):
        part = boosting.predict(rows, model).withColumns({"seed": F.lit(seed), "family": name})
        stacked = part if stacked is None else stacked.unionByName(part)
    w = Window.partitionBy("client_id", "seed")
    e = F.exp(F.col("score") - F.max("score").over(w))
    p = stacked.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w))
    return p.groupBy("client_id").agg(*((F.sum(F.when(F.col("family") == c, F.col("p"))) / len(models)).alias(c) for c in C.CLASSES))


def fit_keyword(long: DataFrame, labels: DataFrame, seeds: tuple[int, ...] = (0,), settings: Settings = KEYWORD, folds: int = C.FOLDS) -> tuple[list[Model], logistic.Model]:
    """Stage 1: binary boosters of (client, family) rows, one for each seed. Stage 2: multinomial logistic
    regression of the label on the inputs that stage 1 gives for clients it has not seen (inner folds by hash,
    seed 1000 more than the first)."""
    rows = long.withColumnRenamed("fam_id", "family_id").withColumnRenamed("fam", "family").join(labels, "client_id").withColumn("target", (F.col("family") == F.col("label")).cast("int"))
    names = [c for c in numbers(rows) if c != "family_id"]
    final = [boosting.fit(rows, names, "target", replace(settings, seed=s)) for s in seeds]
    fold, unseen = fold_of(1000 + seeds[0], F.col("client_id")), None
    for k in range(folds):
        inner = boosting.fit(rows.where(fold != k), names, "target", replace(settings, seed=seeds[0]))
        part = boosting.predict(rows.where(fold == k), inner)
        unseen = part if unseen is None else unseen.unionByName(part)
    inputs = _stage_two(unseen).join(labels, "client_id")
    return final, logistic.fit(inputs, [c for c in inputs.columns if c not in ("client_id", "label")], "label", C.CLASSES)


def _stage_two(scores: DataFrame) -> DataFrame:
    """client_id and the inputs of the second stage, missing ones as 0."""
    p = scores.groupBy("client_id", "family_id").agg(F.avg(1 / (1 + F.exp(-F.col("score")))).alias("p"))
    wide = p.groupBy("client_id").agg(*(F.max(F.when(F.col("family_id") == i, F.col("p"))).alias(f) for i, f in enumerate(C.FAMILIES)))
    return keyword.stage_two_inputs(wide)


def predict_keyword(fitted: tuple[list[Model], logistic.Model], long: DataFrame) -> DataFrame:
    stage_one, stage_two = fitted
    rows = long.withColumnRenamed("fam_id", "family_id").withColumnRenamed("fam", "family")
    scores = None
    for model in stage_one:
        part = boosting.predict(rows, model)
        scores = part if scores is None else scores.unionByName(part)
    return logistic.predict(_stage_two(scores), stage_two)


def gain_importance(models: list[Model], spark) -> DataFrame:
    """feature, feature_group, gain (share of the whole), averaged over the models."""
    rows = []
    for m in models:
        gains = m.importance()
        total = sum(gains.values()) or 1.0
        rows += [(f, features.feature_group(f), g / total / len(models)) for f, g in gains.items()]
    df = spark.createDataFrame(rows, "feature string, feature_group string, gain double")
    return df.groupBy("feature", "feature_group").agg(F.sum("gain").alias("gain")).orderBy(F.desc("gain"), "feature")


def local_explanations(model: Model, rows: DataFrame, chances: DataFrame, places: int = 10) -> DataFrame:
    """The strongest contributions for the client with the surest family and the one with the surest none."""
    first = lambda value: chances.orderBy(F.desc(F.round(value, 12)), "client_id").limit(1).select("client_id")
    picked = first(F.greatest(*C.FAMILIES)).unionByName(first(F.col(C.NONE))).distinct()
    found = boosting.explain(rows.join(picked, "client_id", "left_semi"), model).where(F.col("feature") != "base")
    order = Window.partitionBy("client_id", "family_id").orderBy(F.desc(F.round(F.abs("contribution"), 9)), "feature")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= places)
