import re

from pyspark.sql import functions as F

from ringwatch.operators import investigation
from ringwatch.sources.platform import Platform

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_cut_down_before_they_meet_orders(spark):
    p = Platform(spark, SF)
    ids = p.comment.select("comment_id").limit(7)
    some = p.comments_among(ids)
    assert some.count() == p.comment.join(ids, "comment_id", "left_semi").count() == 7
    assert some.columns == p.comment.columns
    videos = p.video.select("video_id").limit(5)
    assert not p.comments_among(videos).exceptAll(p.comment.join(videos, "video_id", "left_semi").select(*p.comment.columns)).count()
    plan = _plan(p.comments_among(videos))
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")  # the semi join is below the join with orders


def test_seeds_go_on_past_members_without_a_channel(spark):
    p = Platform(spark, SF)
    members = investigation.ring_members(p)
    lost = members.select("ring_id").distinct().limit(3).withColumns({"threat_class": F.lit("t01"), "entity_kind": F.explode(F.array(F.lit("comment"), F.lit("video")))}).withColumn("entity_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("a"), i.cast("string")))))
    never = spark.createDataFrame([("ring_x", "t01", "comment", f"b{i}") for i in range(9)] + [("ring_y", "t01", "comment", None)], "ring_id string, threat_class string, entity_kind string, entity_id string")
    whole = {tuple(r) for r in investigation.ring_seeds(p, members, least=1 << 20).collect()}
    assert len(whole) == members.select("ring_id").distinct().count() > 3
    assert {tuple(r) for r in investigation.ring_seeds(p, members.unionByName(lost).unionByName(never), least=2).collect()} == whole
    assert {tuple(r) for r in investigation.ring_seeds(p).collect()} == whole


def test_members_are_worked_out_once(spark):
    from ringwatch.plans import registry

    plan = _plan(registry._recovered(Platform(spark, SF)))
    assert not re.search(r"l_orderkey", plan)
