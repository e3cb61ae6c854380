"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of this process on a local
    master; on a cluster executors would each write to their own disk, so that raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _OWN_FOLDER[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: what is built on it neither repeats its work nor carries its plan."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove the tables that this process has stored so far; how many there were. For callers that have
    written or collected the results: DataFrames that read these tables fail afterwards."""
    jvm, n = spark._jvm, len(_WRITTEN)
    for path in _WRITTEN:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.clear()
    return n
