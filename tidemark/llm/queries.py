"""Queries of this subpackage: each applies an operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language, licences, mixing, neighbours, quality, scoring, secret_scan, simhash, toxicity
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.op1_neighbours(table(spark, sf_dir, "embeddings"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op2_secrets(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.op4_scoring(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5_mixing(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6_simhash(table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op7_licences(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op8_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op10_language(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [op1_neighbours, op2_secrets, op3_quality, op4_scoring, op5_mixing, op6_simhash, op7_licences, op8_decontamination, op9_toxicity, op10_language]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE_SQL, "op8_decontamination": decontamination.ORACLE_SQL}
