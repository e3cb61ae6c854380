"""All queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import evaluation_queries, file_queries, kernel_queries, keyword_queries, model_queries, noise_queries, parser_queries
from tidemark.plans.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, grammar, streams, prior, posterior and the features of every client and family."""
    return parser_queries.all_features(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
