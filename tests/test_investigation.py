"""Investigations in waves against the loop that works hop by hop, bitmaps against pairs, draws against exact distributions."""

import math
import os

import pytest
from pyspark.sql import functions as F

from ringwatch.operators import draws, graph, investigation, triage
from ringwatch.sources.platform import Platform

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_waves_find_what_the_loop_finds(spark):
    p = Platform(spark, SF)
    seeds = spark.createDataFrame([("r1", "chan_5", "channel"), ("r2", "acct_7", "account"), ("r3", "vid_1", "video")], "seed string, node_id string, kind string")
    nodes, hops = investigation.explore(p, seeds, budget=5, limit=4)
    got = {(r["seed"], r["node_id"], r["kind"], r["hop_index"]) for r in nodes.collect()}
    want = {("r3", "vid_1", "video", 0)}  # a video offers no pivot
    for seed, node, kind in (("r1", "chan_5", "channel"), ("r2", "acct_7", "account")):
        pack = graph.investigate(p, node, kind, 5, limit=4)
        want |= {(seed, r["node_id"], r["kind"], r["hop_index"]) for r in pack.nodes.collect()}
        mine = {(r["hop_index"], r["pivot_kind"], r["subject"], r["row_count"]) for r in hops.where(F.col("seed") == seed).collect()}
        assert mine == {(r["hop_index"], r["pivot"], r["subject"], r["row_count"]) for r in pack.provenance.where("hop_index > 0").collect()}
    assert got == want and len(got) > 12


def test_unknown_relations(spark):
    pack = graph.seed(spark, "a", "account")
    edges = spark.createDataFrame([("e", "a", "b", "owns", 1), ("f", "a", "c", "likes", 1)], graph.EDGE)
    assert [tuple(r) for r in graph.unknown_relations(graph.Pack(pack.nodes, edges, pack.events, pack.provenance)).collect()] == [("unknown_relation", "f")]


def test_recovery_and_its_mean(spark):
    members = spark.createDataFrame([("a", "t01", "account", "x1"), ("a", "t01", "account", "x2"), ("a", "t01", "comment", "c1"), ("a", "t01", "channel", "s"), ("b", "t01", "account", "y1"), ("c", "t07", "comment", "c9")], "ring_id string, threat_class string, entity_kind string, entity_id string")
    seeds = spark.createDataFrame([("a", "s"), ("b", "z"), ("c", "q")], "seed string, node_id string")
    nodes = spark.createDataFrame([("a", "s", 0), ("a", "x1", 4), ("a", "x2", 9), ("b", "y1", 20), ("b", "x1", 1)], "seed string, node_id string, hop_index int")
    rows = investigation.recovered(nodes, members, seeds)
    got = {(r["ring_id"], r["budget"]): (r["members"], r["reachable"], r["found"]) for r in rows.collect()}
    assert got == {("a", 5): (3, 2, 1), ("a", 10): (3, 2, 2), ("a", 20): (3, 2, 2), ("b", 5): (1, 1, 0), ("b", 10): (1, 1, 0), ("b", 20): (1, 1, 1), ("c", 5): (1, 0, 0), ("c", 10): (1, 0, 0), ("c", 20): (1, 0, 0)}
    mean = {(r["threat_class"], r["budget"]): (r["cases"], r["recovery"], r["of_reachable"]) for r in investigation.mean_recovery(rows).collect()}
    assert mean["t01", 10] == (2, pytest.approx(1 / 3), 0.5) and mean["t07", 20] == (1, 0.0, 0.0)


def test_bitmaps_count_holders(spark):
    hints = spark.range(70_000).select(F.concat(F.lit("acct_"), F.col("id")).alias("subject_id"), F.lit("shared_device").alias("signal_type"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 1000)).alias("signal_value"))
    bits = triage.holder_bits(hints.unionByName(hints.limit(500)))
    sizes = {r["signal_value"]: r["n"] for r in bits.groupBy("signal_value").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    want = {r["signal_value"]: r["n"] for r in hints.groupBy("signal_value").agg(F.count_distinct("subject_id").alias("n")).collect()}
    assert sizes == want and bits.where("signal_value = 'hot'").count() <= 12


@pytest.mark.parametrize("n,p", [(1, 0.5), (10, 0.0), (10, 1.0), (60, 0.03), (900, 0.4), (5000, 0.001), (20_000, 0.7)])
def test_distributions_are_binomial(spark, n, p):
    row = draws.with_distribution(spark.createDataFrame([(n, p)], "n long, p double"), "n", "p").first()
    exact = lambda j: math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + (j * math.log(p) if j else 0) + ((n - j) * math.log(1 - p) if j < n else 0)) if 0 < p < 1 else float(j == n * p)
    total = 0.0
    for j, got in zip(range(row["low"], n + 1), row["upto"], strict=False):
        total += exact(j)
        assert got == pytest.approx(total, abs=1e-9)
    assert row["upto"][-1] == pytest.approx(1, abs=1e-9) and len(row["upto"]) <= 18 * math.sqrt(n * p * (1 - p)) + 24
    u = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "u double").crossJoin(draws.with_distribution(spark.createDataFrame([(n, p)], "n long, p double"), "n", "p")).select("u", draws.inverted(F.col("u")).alias("k")).orderBy("u").collect()
    assert 0 <= u[0]["k"] <= u[1]["k"] <= u[2]["k"] <= n and abs(u[1]["k"] - n * p) <= 1
