from ringwatch.operators import triage


def test_values_are_counted_where_their_channel_was_dealt(spark):
    posts = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", None), (None, "b")], "channel_id string, account_id string")
    hints = spark.createDataFrame([("a", "t", "v", 0), ("b", "t", "v", 90_000_000), ("b", "t", "w", 0)], "subject_id string, signal_type string, signal_value string, observed_ms long")
    inbound = triage.coordinated(posts, hints)
    assert [tuple(r) for r in inbound.collect()] == [("c", "t", "v")]
    plan = triage.coordinated(posts, hints)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]  # no counts of all channels before the deal
    days = triage.recidivism(inbound, inbound, hints)
    assert [tuple(r) for r in days.collect()] == [("c", 2, 0.25)]
    plan = triage.recidivism(inbound, inbound, hints)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("BroadcastHashJoin")]
