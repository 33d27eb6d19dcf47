"""Chains in ranges of seq, anchors, activation logs, and appends on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from ringwatch.operators import ledger
from ringwatch.streaming import appends


def _entries(spark, sizes):
    rows = [(s, i, f"2024-01-01T00:00:{i % 60:02d}+05:30", None if i % 3 else "a1", "m", ledger.EVENTS[i % 11], f"p{s}:{i}") for s, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "session long, seq long, timestamp_ist string, agent_id string, mandate_hash string, event_type string, payload_digest string")


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_ranges_give_what_one_window_gives(spark, monkeypatch, span):
    monkeypatch.setattr(ledger, "SPAN", span)
    chain = ledger.chained(_entries(spark, {1: 50, 2: 33, 3: 1, 4: 20}), "session").cache()
    writer = ledger.Writer()
    for r in sorted((r for r in chain.collect() if r["session"] == 1), key=lambda r: r["seq"]):
        row = writer.append(r["timestamp_ist"], r["agent_id"] or None, r["mandate_hash"], r["event_type"], r["payload_digest"])
        assert (row["prev_hash"], row["entry_hash"]) == (r["prev_hash"], r["entry_hash"])
    forged = chain.where("NOT (session = 2 AND seq = 14)").withColumn("prev_hash", F.when(F.expr("session = 4 AND seq = 7"), "x").otherwise(F.col("prev_hash")))
    got = {r["session"]: (r["entries"], r["first_break"], r["reason"]) for r in ledger.verified(forged, "session").collect()}
    assert got == {1: (50, None, None), 2: (32, 14, "seq_gap"), 3: (1, None, None), 4: (20, 7, "prev_hash_mismatch")}
    anchors = ledger.heads(chain, "session").unionByName(spark.createDataFrame([(9, "3:x")], "session long, head string"))
    cut = forged.where("NOT (session = 1 AND seq = 49)")
    assert {r["session"]: r["outcome"] for r in ledger.anchored(cut, anchors, "session").collect()} == {1: "head_mismatch", 2: "broken_chain", 3: "intact", 4: "broken_chain", 9: "head_mismatch"}


def test_a_long_session_is_checked_in_many_tasks(spark):
    n = 200_000
    long = spark.range(n).select(F.lit(1).cast("long").alias("session"), F.col("id").alias("seq"), F.lit("t").alias("timestamp_ist"), F.lit("a").alias("agent_id"), F.lit("m").alias("mandate_hash"), F.lit("prompt_sent").alias("event_type"), F.sha2(F.col("id").cast("string"), 256).alias("payload_digest"))
    chain = ledger.chained(long, "session").cache()
    assert [(r["entries"], r["ok"]) for r in ledger.verified(chain, "session").collect()] == [(n, True)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranges = ledger.in_order(chain, ["session"], ["entry_hash"]).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in ranges) <= 2 * ledger.SPAN


def test_log_faults(spark):
    rows = [("a", 0, "t", "d1", "activate", "09"), ("a", 1, "t", "d1", "rollback", "08"), ("a", 2, "t", "d9", "rollback", "10"), ("b", 1, "t", "d1", "activate", "09"), ("b", 2, "t", "d1", "activate", "09")]
    df = spark.createDataFrame(rows, "log string, seq long, task string, content_digest string, action string, timestamp_ist string")
    assert sorted(tuple(r) for r in ledger.log_faults(df, "log").collect()) == [("a", 1, "moves_back_in_time"), ("a", 2, "rollback_to_unknown"), ("b", 1, "seq_gap"), ("b", 2, "seq_gap")]


def test_stream_refuses_where_the_batch_breaks(spark, tmp_path):
    chain = ledger.chained(_entries(spark, {1: 40, 2: 25, 3: 30}), "session")
    forged = chain.withColumn("payload_digest", F.when(F.expr("session = 2 AND seq = 11"), "x").otherwise(F.col("payload_digest"))).where("NOT (session = 3 AND seq = 20)")
    for part in range(4):  # files in order of time
        forged.where(F.expr(f"seq >= {part * 10} AND seq < {part * 10 + 10}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    old = spark.conf.get(appends.PROVIDER[0], None)
    spark.conf.set(*appends.PROVIDER)
    try:
        stream = spark.readStream.schema(chain.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run = appends.appended(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination(200)
        assert run.exception() is None and not run.isActive
    finally:
        spark.conf.set(appends.PROVIDER[0], old) if old else spark.conf.unset(appends.PROVIDER[0])
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("session").agg(F.count("*").alias("n"), F.min(F.when(F.col("verdict") != "accepted", F.col("seq"))).alias("first"), F.min_by("verdict", F.when(F.col("verdict") != "accepted", F.col("seq"))).alias("why")).collect()
    batch = {r["session"]: (r["entries"], r["first_break"], r["reason"]) for r in ledger.verified(forged, "session").collect()}
    assert {r["session"]: (r["n"], r["first"] if r["session"] != 3 else 20, r["why"]) for r in got} == batch and {r["session"]: r["first"] for r in got} == {1: None, 2: 11, 3: 21}
