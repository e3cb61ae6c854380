"""Multinomial logistic regression, fitted by Spark ML and scored by column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Model:
    """names of the inputs; classes; weights and an offset for each class."""

    names: list[str]
    classes: tuple[str, ...]
    weights: list[list[float]]
    offsets: list[float]


def fit(rows: DataFrame, names: list[str], label: str, classes: tuple[str, ...], strength: float = 1.0, iterations: int = 2000) -> Model:
    """Minimises half the squared weights plus strength times the summed loss; offsets are not shrunk. Missing
    inputs are 0. Classes without a row get no weight and the least offset."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    at = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    prepared = rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names), at.cast("double").alias("at")).where("at >= 0")
    n = prepared.count()
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(prepared).select("features", "at").persist()
    try:
        fitted = LogisticRegression(featuresCol="features", labelCol="at", family="multinomial", regParam=1 / (strength * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-8).fit(assembled)
    finally:
        assembled.unpersist()
    weights, offsets = fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist()
    least = min(offsets, default=0.0) - 30.0
    missing = len(classes) - len(offsets)
    return Model(list(names), tuple(classes), weights + [[0.0] * len(names)] * missing, offsets + [least] * missing)


def predict(rows: DataFrame, model: Model, key: str = "client_id") -> DataFrame:
    """key and the chance of each class."""
    def score(weights: list[float], offset: float) -> Column:
        terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(w) for c, w in zip(model.names, weights, strict=True)]
        return sum(terms, F.lit(offset))

    scores = rows.select(key, *(score(w, o).alias(c) for c, w, o in zip(model.classes, model.weights, model.offsets, strict=True)))
    scores = scores.withColumn("top", F.greatest(*model.classes))
    shares = scores.select(key, *(F.exp(F.col(c) - F.col("top")).alias(c) for c in model.classes))
    total = sum((F.col(c) for c in model.classes[1:]), F.col(model.classes[0]))
    return shares.select(key, *((F.col(c) / total).alias(c) for c in model.classes))
