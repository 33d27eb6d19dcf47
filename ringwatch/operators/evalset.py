"""Evaluation sets: planted subjects with benign controls, opaque ids, and how a subject is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.operators.measurement import draw

#: Fixed value: the share of benign controls in a set.
BENIGN_SHARE = 0.25


def build(labels: DataFrame, seed: str) -> DataFrame:
    """(item_id, entity_id, threat_class): every planted subject and as many controls as keep the share.

    Controls are the benign subjects with the least hashes. Ids are digests of seed and subject, so neither an id
    nor the order of ids tells a label; join them to labels in the scorer only.
    """
    planted = labels.where("threat_class <> 'benign'")
    wanted = int(planted.count() * BENIGN_SHARE / (1 - BENIGN_SHARE) + 0.5)
    pool = labels.where("threat_class = 'benign'").select(F.col("entity_id").alias("view_id"), F.lit("benign").alias("band"))
    controls = draw(pool, {"benign": wanted}, seed).select(F.col("view_id").alias("entity_id"), F.lit("benign").alias("threat_class"))
    both = planted.select("entity_id", "threat_class").unionByName(controls)
    return both.select(F.concat(F.lit("item-"), F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "entity_id"), 256), 1, 16)).alias("item_id"), "entity_id", "threat_class")


def leaks(rendered: DataFrame, classes: list[str]) -> DataFrame:
    """Items whose content names a class; a set with any is refused."""
    return rendered.where(F.lower("content").rlike(r"\b(?:" + "|".join(classes) + r")\b")).select("item_id")


def account_content(comments: DataFrame) -> DataFrame:
    """What an evaluator reads of an account: comments, distinct texts, and the most videos under one text."""
    by_text = comments.groupBy("account_id", "text").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video_id").alias("v"))
    counted = by_text.groupBy("account_id").agg(F.sum("n").alias("comments"), F.count(F.lit(1)).alias("texts"), F.max("v").alias("videos"), F.array_sort(F.collect_list("text")).alias("t"))
    content = F.concat(F.lit("comments: "), "comments", F.lit("; videos: "), "videos", F.lit("; texts: "), F.array_join("t", " | "))
    return counted.select("account_id", "comments", "texts", "videos", content.alias("content"))
