"""Planted threats: budgets, least forms, and each kind's structure."""

import collections

import pytest
from pyspark.sql import functions as F

from ringwatch.operators import graph, pivots, triage
from ringwatch.sources import generate, threats

LEAST = {"t02": 3, "t03": 1, "t04": 3, "t05": 3, "t06": 3, "t07": 8}


@pytest.mark.parametrize("budget", [1, 2, 3, 5, 8, 10, 19, 50])
def test_shapes_fit_their_budget(budget):
    for kind, shape in threats.SHAPES.items():
        fit = shape.within(budget)
        assert fit.size() <= max(budget, LEAST[kind]) and fit.size() <= shape.size()
        assert shape.within(LEAST[kind]).size() == LEAST[kind]
    assert threats.class_budget(7000) == 20 and threats.class_budget(3) == 1


@pytest.fixture(scope="module")
def planted(spark):
    videos = spark.createDataFrame([(f"vid_{i}",) for i in range(5)], "video_id string")
    return {k: {n: df.collect() for n, df in threats.plant(spark, k, s, "9", videos).items()} for k, s in threats.SHAPES.items()}


def test_labels_are_the_entities(planted):
    keys = {"account": ("account_meta", "account_id"), "channel": ("channel", "channel_id"), "video": ("video", "video_id"), "comment": ("comment", "comment_id")}
    for kind, views in planted.items():
        labels = views["sealed_labels"]
        want = {(e, r[key]) for e, (view, key) in keys.items() for r in views.get(view, [])}
        assert {(r["entity_kind"], r["entity_id"]) for r in labels} == want and len(labels) == len(want) == threats.SHAPES[kind].size()
        assert {r["threat_class"] for r in labels} == {kind}


def test_pods_engage_with_each_other_only(planted):
    v = planted["t02"]
    owner = {r["channel_id"]: r["account_id"] for r in v["channel"]} | {r["video_id"]: next(c["account_id"] for c in v["channel"] if c["channel_id"] == r["channel_id"]) for r in v["video"]}
    pairs = collections.Counter((e["account_id"], owner[e["video_id"] or e["channel_id"]]) for e in v["engagement_event"])
    assert len(pairs) == 2 * 3 * 2 and set(pairs.values()) == {3} and all(a != b and a.rsplit("_", 1)[0] == b.rsplit("_", 1)[0] for a, b in pairs)
    assert len({r["device_fingerprint_hint"] for r in v["account_meta"]}) == 2 == len({r["signup_ip_bucket"] for r in v["account_meta"]})


def test_structures(planted):
    t03 = planted["t03"]
    assert {r["signal_type"] for r in t03["infra_hint"]} == {"link_domain_reuse"} and len({r["signal_value"] for r in t03["infra_hint"]}) == 2
    assert len(t03["comment"]) == 12 and all(r["video_id"].startswith("vid_") and r["template_id"] is None for r in t03["comment"]) and "channel" not in t03
    for kind in ("t04", "t05"):
        assert {(r["synthetic_media_disclosed"], r["provenance_signal"]) for r in planted[kind]["video"]} == {(False, "absent")} and "infra_hint" not in planted[kind]
    t06 = planted["t06"]
    assert {r["subject_kind"] for r in t06["infra_hint"]} == {"channel"} and len({r["signal_value"] for r in t06["infra_hint"]}) == 1 and len(t06["channel"]) == 3
    t07 = planted["t07"]
    own = {r["account_id"]: r["channel_id"] for r in t07["channel"]}
    video = {r["video_id"]: r["channel_id"] for r in t07["video"]}
    assert all(video[r["video_id"]] != own[r["account_id"]] for r in [*t07["comment"], *t07["engagement_event"]])
    assert len({r["template_id"] for r in t07["comment"]}) == 1 and {r["signal_value"] for r in t07["infra_hint"]} == {r["signup_ip_bucket"] for r in t07["account_meta"]}
    burst = sorted(r["ts_ms"] for r in planted["t02"]["engagement_event"] if r["account_id"].startswith("t02_acct_0"))
    assert sum(burst[i + 9] - burst[i] <= 2 * 3_600_000 for i in range(len(burst) - 9)) > 0


def test_all_kinds_are_planted_and_benign_stays_the_majority(spark):
    views = generate.build(spark, 42, 2)
    labels = views["sealed_labels"].groupBy("threat_class").count().collect()
    n = {r["threat_class"]: r["count"] for r in labels}
    assert set(n) == {"benign", "t01", *threats.SHAPES} and n["benign"] / sum(n.values()) >= 0.97
    assert views["sealed_labels"].groupBy("entity_kind", "entity_id").count().where("count > 1").isEmpty()
    again = generate.build(spark, 42, 2)["sealed_labels"]
    assert views["sealed_labels"].exceptAll(again).isEmpty()
    found = triage.flagged(views["channel"], views["video"], views["comment"], views["infra_hint"])
    assert {r["channel_id"] for r in found.where("channel_id LIKE 't06%'").collect()} == {f"t06_chan_0_{i}" for i in range(3)}
    ring = graph.rings(views["sealed_labels"]).where("ring_id = 'ring_t02_0'")
    assert ring.count() == threats.SHAPES["t02"].within(threats.class_budget(views["account_meta"].count() + views["channel"].count() + views["video"].count() + views["comment"].count())).size() // 2
    pod = pivots.engagement_edge(views["engagement_event"], views["video"], "t02_chan_0_0")
    assert {r["account_id"] for r in pod.collect()} == {"t02_acct_0_1", "t02_acct_0_2"} or pod.where(F.col("account_id").startswith("t02_acct_0")).count() >= 2
