"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, source mix.

Every stage takes what the one before kept. All stages but the last return the columns of docs as they are, keep
rows as often as they come unless they say otherwise, read whole texts, ignore further columns and columns with
names that operators use inside, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language, mixing, near_copies, secret_scan, simhash
from tidemark.llm.common import stored, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is found without ambiguity. Null texts and texts without a letter go; a null
    doc_id stays; without any labelled row every document goes."""
    return language.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: of the least doc_id, nulls last. Of equal such rows the least by
    the other columns stays. Null and wordless texts are copies of each other."""
    return simhash.keep_one(docs, near_copies.near_copies)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of 10 words of a benchmark item, or a shorter item whole. Null and
    wordless texts stay; null and empty items match nothing."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark, overlapping ones by one; n_chars follows. Null texts stay null."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix of sources takes it, with the number of the copy in `copy`; documents
    that it does not take go, those without words among them. A null source is a source of its own; equal rows are
    split by count."""
    return mixing.repeated(docs)


STAGES = [
    ("language", identified),
    ("near-duplicates", deduplicated),
    ("benchmark passages", decontaminated),
    ("secrets", redacted),
    ("source mix", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
