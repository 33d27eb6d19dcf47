import time

from pyspark.sql import functions as F

from ringwatch.llm import fingerprint


def test_alignment_of_many_anchors_is_not_each_with_each(spark):
    anchors = lambda shift: F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: F.struct(i.alias("place"), F.xxhash64(i + F.when(i % 3 == 0, shift).otherwise(0)).alias("hash")))
    df = spark.range(1).select(anchors(F.col("id").cast("int")).alias("a"), anchors(F.col("id").cast("int") + 100_000).alias("b"))
    start = time.monotonic()
    assert df.select(fingerprint.aligned(F.col("a"), F.col("b"))).first()[0] == 40_000 / 60_000
    assert time.monotonic() - start < 15
