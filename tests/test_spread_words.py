"""Holders of the same values count as one bit with a weight; commenters coordinate only if they differ; dealt views have the rows of plain ones in finer partitions."""

from pyspark.sql import functions as F

from ringwatch.operators import triage
from ringwatch.sources.platform import FINER, Platform


def test_words_count_holders(spark):
    each = spark.range(20_000).withColumn("subject_id", F.concat(F.lit("acct_"), "id"))
    kinds = (("d", "concat('v', int(sqrt(id)) % 90)"), ("n", "concat('n', id % 3)"), ("d", "if(id = 7, 'one', 'hot')"))
    parts = [each.selectExpr("subject_id", f"'{k}' signal_type", f"{v} signal_value") for k, v in kinds]
    hints = parts[0].unionByName(parts[1]).unionByName(parts[2])
    hints = hints.unionByName(hints.limit(300))
    bits, weights = triage.holder_words(hints)
    assert bits.where("signal_value = 'hot'").count() <= 40  # hundreds of kinds of holders, where there are 19,999 holders
    channels = spark.createDataFrame([("c1", "acct_5"), ("c2", "acct_7"), ("c3", "x")], "channel_id string, account_id string")
    held = [("c1", "d", "v3"), ("c1", "n", "n1"), ("c2", "d", "one"), ("c2", "d", "v2"), ("c3", "d", "hot")]
    own = spark.createDataFrame(held, "channel_id string, signal_type string, signal_value string")
    got = {r["channel_id"]: r["peer_entities"] for r in triage.spread(channels, own, own.limit(0), hints).collect()}
    met = own.join(hints, ["signal_type", "signal_value"]).join(channels, "channel_id").where("subject_id <> account_id")
    assert got == {r["channel_id"]: r["n"] for r in met.groupBy("channel_id").agg(F.count_distinct("subject_id").alias("n")).collect()} and got["c3"] == 19_999


def test_repeats_do_not_coordinate(spark):
    posts = spark.createDataFrame([("c", "a"), ("c", "a"), ("d", "a"), ("d", "b"), ("d", "b")], "channel_id string, account_id string")
    hints = spark.createDataFrame([("a", "t", "x"), ("a", "t", "x"), ("b", "t", "x"), ("b", "t", "y")], "subject_id string, signal_type string, signal_value string")
    assert [tuple(r) for r in triage.coordinated(posts, hints).collect()] == [("d", "t", "x")]


def test_dealt_comments_are_all_comments(spark):
    p = Platform(spark, "/root/testdata/sf0.001")
    plain, dealt = p.comment, p.dealt("comment")
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()
    assert dealt.rdd.getNumPartitions() == FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
