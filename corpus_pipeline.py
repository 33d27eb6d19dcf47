"""Cleans and packs ``documents``: quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm import jaccard, packing, pii, quality
from ringwatch.llm.common import saved, table
from ringwatch.llm.registry import BYTE_BPE, PII_KEY


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the co-trained quality classifier accepts.

    Nulls in any column are values of their own and a null text is an empty one; repeated rows and ties are judged alike; very long texts are judged whole.
    No rows give no rows. Without labels of both kinds all stay. Extra columns pass through.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group linked by 0.8 of their 5-word shingles, in order of doc_id (null last).

    Each row has a key of its own (its doc_id, where none is null or repeated), so rows with one doc_id or a null one are compared as any others.
    Rows without words are no copies of others, save repeats of one doc_id. No rows give no rows; of rows alike in all columns one stays.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        keyed = docs.withColumn("_key", F.col("doc_id"))
    else:
        keyed = saved(docs.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    groups = jaccard.groups(keyed.select(F.col("_key").alias("doc_id"), "text"), words=5, percent=80)
    empty = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    row = groups.select(F.col("doc_id").alias("_key"), "component_id", "n_shingles").join(keyed.select("_key", "doc_id", F.xxhash64(*docs.columns).alias("_hash"), F.xxhash64("text").alias("_text")), "_key")
    row = row.withColumn("_same", F.when(empty, F.struct(F.lit(1).alias("kind"), F.col("doc_id").alias("a"), F.col("_text").alias("b"))).otherwise(F.struct(F.lit(0).alias("kind"), F.col("component_id").alias("a"), F.lit(0).cast("long").alias("b"))))
    first = row.groupBy("_same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_hash", "_key"))["_key"].alias("_key"))
    return keyed.join(first, "_key", "left_semi").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, and their new lengths.

    A null text stays null. Rows are mapped one by one, repeated and very long ones too; no rows give no rows. Extra columns pass through.
    """
    new = pii.pseudonymize(docs, PII_KEY)
    return new.withColumn("n_chars", F.when(F.size(new.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens.

    A null text is empty and takes its end id alone. Rows with one doc_id, or a null one, are packed each for itself; very long texts are cut. No rows give no rows.
    Extra columns are ignored.
    """
    return packing.pack(docs, BYTE_BPE)


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", private), ("packing", packed)]
#: No stage but the third could be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
