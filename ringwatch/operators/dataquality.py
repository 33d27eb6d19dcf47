"""Data-quality gate: profile, rule validation, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of each view. (column, rule, argument)
KINDS = ["view", "like", "dislike", "share", "subscribe", "report"]
RULES = {
    "account_meta": [("account_id", "unique", None), ("account_id", "not_null", None), ("created_ms", "not_null", None), ("created_ms", "not_future", None)],
    "channel": [("channel_id", "unique", None), ("channel_id", "not_null", None), ("account_id", "not_null", None)],
    "video": [
        ("video_id", "unique", None), ("video_id", "not_null", None), ("channel_id", "not_null", None), ("published_ms", "not_future", None), ("duration_s", "range", 0),
        ("provenance_signal", "allowed", ["present", "absent", "unknown"]),
    ],
    "comment": [("comment_id", "unique", None), ("comment_id", "not_null", None), ("video_id", "not_null", None), ("account_id", "not_null", None), ("posted_ms", "not_future", None)],
    "engagement_event": [("event_id", "unique", None), ("event_id", "not_null", None), ("account_id", "not_null", None), ("ts_ms", "not_future", None), ("kind", "allowed", KINDS)],
    "infra_hint": [
        ("hint_id", "unique", None), ("hint_id", "not_null", None), ("subject_id", "not_null", None), ("observed_ms", "not_future", None), ("subject_kind", "allowed", ["account", "channel", "video", "comment"]),
        ("signal_type", "allowed", ["shared_upload_pattern", "template_reuse", "shared_device", "shared_ip_bucket", "link_domain_reuse"]),
    ],
}
#: Thresholds of the profile, in percent.
THRESHOLDS = {"completeness": 60, "uniqueness": 99, "validity": 95}


def _exceptions(column: str, rule: str, arg: object, now_ms: int) -> Column:
    c = F.col(column)
    if rule == "unique":
        return F.count(c) - F.count_distinct(c)
    bad = {"not_null": c.isNull(), "not_future": c > now_ms, "range": c < arg if rule == "range" else None, "allowed": ~c.isin(arg) if rule == "allowed" else None}[rule]
    return F.count_if(bad)


def validate(name: str, df: DataFrame, now_ms: int) -> DataFrame:
    """Exceptions to each rule of a view, in one aggregate."""
    rules = RULES[name]
    row = df.agg(*[_exceptions(*r, now_ms).alias(f"r{i}") for i, r in enumerate(rules)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("rule"), F.col(f"r{i}").cast("long").alias("exceptions")) for i, (c, k, _) in enumerate(rules)]))
    return row.select(F.lit(name).alias("table"), cells.alias("x")).select("table", "x.*").withColumn("passed", F.col("exceptions") == 0)


def profile(name: str, df: DataFrame, now_ms: int) -> DataFrame:
    """Completeness (filled cells), uniqueness (distinct keys) and validity (rows that meet the row rules).

    These definitions are this engine's own.
    """
    rules = RULES[name]
    key = rules[0][0]
    filled = reduce(lambda a, b: a + b, [F.count(c) for c in df.columns])
    row_ok = reduce(lambda a, b: a & b, [_row_ok(*r, now_ms) for r in rules if r[1] != "unique"])
    return df.agg(
        F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), (filled / (F.count(F.lit(1)) * len(df.columns))).alias("completeness"),
        (F.count_distinct(key) / F.count(F.lit(1))).alias("uniqueness"), (F.count_if(row_ok) / F.count(F.lit(1))).alias("validity"),
    )


def _row_ok(column: str, rule: str, arg: object, now_ms: int) -> Column:
    c = F.col(column)
    if rule == "not_null":
        return c.isNotNull()
    return F.coalesce({"not_future": lambda: c <= now_ms, "range": lambda: c >= arg, "allowed": lambda: c.isin(arg)}[rule](), F.lit(True))


def reconcile(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Entities without a label and labels without an entity, by kind. Both have entity_kind and entity_id."""
    a, b = entities.select("entity_kind", "entity_id").distinct().withColumn("_a", F.lit(1)), labels.select("entity_kind", "entity_id").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, ["entity_kind", "entity_id"], "full_outer")
    return both.groupBy("entity_kind").agg(F.count_if(F.col("_b").isNull()).alias("unlabelled"), F.count_if(F.col("_a").isNull()).alias("unknown"), F.count(F.lit(1)).alias("ids"))


def passes(validated: DataFrame, reconciled: DataFrame, profiled: DataFrame) -> bool:
    """Whether all three parts of the gate hold."""
    low = reduce(lambda a, b: a | b, [F.col(k) * 100 < v for k, v in THRESHOLDS.items()])
    return validated.where("not passed").isEmpty() and reconciled.where("unlabelled > 0 or unknown > 0").isEmpty() and profiled.where(low).isEmpty()
