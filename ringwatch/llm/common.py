"""Session helpers shared by the operators: table access, shared scratch tables, ranks."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder every executor shares (``spark.checkpoint.dir``).

    A local one is made only where the session names none and runs in one JVM; a cluster without such a folder is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="ringwatch-"))
    return f"{base}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to shared storage and read again: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes, since a row may be a very long text; stays so for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that extra ones never clash with derived names."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def salt(columns: list[Column], buckets: int | Column) -> Column:
    """Even bucket number from a hash of ``columns``."""
    count = F.lit(buckets).cast("long") if isinstance(buckets, int) else buckets.cast("long")
    return F.pmod(F.xxhash64(*columns), count).cast("int")


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Gapless rank from 0 within ``keys`` without gathering a key in one task.

    Rows are numbered inside (keys, bucket); each bucket starts after the rows of the buckets
    before it, known from a small table of counts. ``bucket`` must be a function of the row.
    """
    parts = df.withColumn("_bucket", bucket)
    sizes = parts.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = parts.withColumn("_row", F.row_number().over(inside))
    same = [numbered[k].eqNullSafe(bases[k]) for k in [*keys, "_bucket"]]
    kept = [numbered[c] for c in df.columns]
    return numbered.join(F.broadcast(bases) if not keys else bases, reduce(lambda a, b: a & b, same)).select(
        *kept, (F.col("_base") + F.col("_row") - 1).cast("long").alias(name)
    )
