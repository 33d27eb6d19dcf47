"""Tables between the steps of a job, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local one of its own only if the whole session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ringwatch-"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read again: its lineage ends there, and no branch above works it out anew."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
