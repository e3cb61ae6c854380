"""Registry of queries: each is a function of (spark, sf_dir), with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def rounded(df: DataFrame, keys, values, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """keys as they are, values as doubles of so many digits; nudge takes exact halves off the fence."""
    return df.select(*keys, *(F.round(F.col(f"`{v}`").cast("double") + nudge, digits).alias(v) for v in values))


def rounded_sql(source: str, keys, values, digits: int = 6, nudge: float = 0.0) -> str:
    return f"SELECT {', '.join(keys)}, {', '.join(f'round(CAST(\"{v}\" AS DOUBLE) + {nudge}::DOUBLE, {digits}) AS \"{v}\"' for v in values)} FROM {source}"
