"""Parameterized pivot queries over the platform views, with validated parameters.

Every pivot is one plan of joins and aggregates with a total order and a limit, so that its rows
are the same in every run. Parameters are values, never identifiers.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = re.compile(r"[A-Za-z0-9_\-]{1,64}")
MAX_ROWS, MAX_HOURS, MAX_FLOOR, MAX_EPOCH_MS = 200, 168, 1000, 4_102_444_800_000


@dataclass(frozen=True)
class Param:
    """A parameter's rule: an entity id, a whole number within bounds, or one of some choices."""

    name: str
    kind: str = "id"
    low: int = 0
    high: int = 0
    choices: tuple[str, ...] = ()

    def fault(self, value: object) -> str | None:
        if self.kind == "id":
            return None if isinstance(value, str) and ID.fullmatch(value) else "invalid_id"
        if self.kind == "choice":
            return None if value in self.choices else "invalid_choice"
        if isinstance(value, bool) or not isinstance(value, int):
            return "not_an_integer"
        return None if self.low <= value <= self.high else "out_of_bounds"


LIMIT = Param("limit", "integer", 1, MAX_ROWS)
FLOOR = lambda name: Param(name, "integer", 1, MAX_FLOOR)
PARAMS: Mapping[str, tuple[Param, ...]] = {
    "shared_metadata": (Param("account_id"), Param("field", "choice", choices=("any", "signup_ip_bucket", "device_fingerprint_hint")), LIMIT),
    "temporal_correlation": (Param("channel_id"), Param("anchor_ms", "integer", 0, MAX_EPOCH_MS), Param("hours", "integer", 1, MAX_HOURS), LIMIT),
    "engagement_edge": (Param("channel_id"), Param("kind", "choice", choices=("any", "view", "like", "dislike", "share", "subscribe", "report")), FLOOR("min_events"), LIMIT),
    "infra_overlap": (Param("subject_id"), LIMIT),
    "account_link": (Param("channel_id"), FLOOR("min_comments"), LIMIT),
}


def faults(pivot: str, values: Mapping[str, object]) -> list[tuple[str, str]]:
    """Every (parameter, code) that is wrong: unexpected names first, then the rules in order."""
    rules = PARAMS[pivot]
    found = [(n, "unexpected") for n in sorted(set(values) - {r.name for r in rules})]
    for rule in rules:
        if rule.name not in values:
            found.append((rule.name, "missing"))
        elif code := rule.fault(values[rule.name]):
            found.append((rule.name, code))
    return found


def checked(pivot: str, values: Mapping[str, object]) -> None:
    if found := faults(pivot, values):
        raise ValueError(f"{pivot}: {found}")


def shared_metadata(accounts: DataFrame, account_id: str, field: str = "any", limit: int = MAX_ROWS) -> DataFrame:
    """Other accounts with the subject's sign-up bucket or device hint."""
    checked("shared_metadata", {"account_id": account_id, "field": field, "limit": limit})
    subject = accounts.where(F.col("account_id") == account_id)
    branches = []
    for name in ("signup_ip_bucket", "device_fingerprint_hint"):
        if field in ("any", name):
            own = F.broadcast(subject.select(F.col(name).alias("shared_value")))  # one account
            peers = accounts.where(F.col("account_id") != account_id).select(F.col("account_id").alias("peer_account_id"), F.lit(name).alias("metadata_field"), F.col(name).alias("shared_value"))
            branches.append(peers.join(own, "shared_value").select("peer_account_id", "metadata_field", "shared_value"))
    out = branches[0] if len(branches) == 1 else branches[0].unionByName(branches[1])
    return out.orderBy("metadata_field", "peer_account_id").limit(limit)


def temporal_correlation(comments: DataFrame, videos: DataFrame, channel_id: str, anchor_ms: int, hours: int = 24, limit: int = MAX_ROWS) -> DataFrame:
    """Comments on a channel's videos within some hours of an instant, both ends included."""
    checked("temporal_correlation", {"channel_id": channel_id, "anchor_ms": anchor_ms, "hours": hours, "limit": limit})
    near = F.col("posted_ms").between(anchor_ms - hours * 3_600_000, anchor_ms + hours * 3_600_000)
    own = videos.where(F.col("channel_id") == channel_id).select("video_id")
    return comments.where(near).join(own, "video_id").select("comment_id", "account_id", "video_id", "posted_ms", "template_id").orderBy("posted_ms", "comment_id").limit(limit)


def engagement_edge(events: DataFrame, videos: DataFrame, channel_id: str, kind: str = "any", min_events: int = 1, limit: int = MAX_ROWS) -> DataFrame:
    """Who engaged with a channel or its videos, how often, first and last."""
    checked("engagement_edge", {"channel_id": channel_id, "kind": kind, "min_events": min_events, "limit": limit})
    events = events if kind == "any" else events.where(F.col("kind") == kind)
    own = videos.where(F.col("channel_id") == channel_id).select("video_id")
    on_videos = events.join(own, "video_id").select("account_id", F.lit("video").alias("target_kind"), F.col("video_id").alias("target_id"), "kind", "ts_ms")
    on_channel = events.where(F.col("channel_id") == channel_id).select("account_id", F.lit("channel").alias("target_kind"), F.col("channel_id").alias("target_id"), "kind", "ts_ms")
    edges = on_videos.unionByName(on_channel).groupBy("account_id", "target_kind", "target_id", "kind")
    counted = edges.agg(F.count(F.lit(1)).alias("event_count"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    return counted.where(F.col("event_count") >= min_events).orderBy(F.desc("event_count"), "account_id", "target_id", "kind").limit(limit)


def infra_overlap(hints: DataFrame, subject_id: str, limit: int = MAX_ROWS) -> DataFrame:
    """Entities that share a signal value with the subject, counted in pairs of hints.

    The subject's hints are counted for each value first and the peers' too, so no pair of hints is ever a row.
    """
    checked("infra_overlap", {"subject_id": subject_id, "limit": limit})
    own = hints.where(F.col("subject_id") == subject_id).groupBy("signal_type", "signal_value").agg(F.count(F.lit(1)).alias("own"))
    peers = hints.where(F.col("subject_id") != subject_id).groupBy("subject_id", "subject_kind", "signal_type", "signal_value")
    counted = peers.agg(F.count(F.lit(1)).alias("n"), F.min("observed_ms").alias("first_ms"), F.max("observed_ms").alias("last_ms"))
    out = counted.join(own, ["signal_type", "signal_value"]).select(
        F.col("subject_id").alias("peer_id"), F.col("subject_kind").alias("peer_kind"), "signal_type", "signal_value", (F.col("n") * F.col("own")).alias("hint_count"), "first_ms", "last_ms"
    )
    return out.orderBy("signal_type", "peer_id", "signal_value", "peer_kind").limit(limit)


def account_link(channels: DataFrame, comments: DataFrame, videos: DataFrame, channel_id: str, min_comments: int = 1, limit: int = MAX_ROWS) -> DataFrame:
    """The channel's owner, and its commenters by number of comments."""
    checked("account_link", {"channel_id": channel_id, "min_comments": min_comments, "limit": limit})
    owner = channels.where(F.col("channel_id") == channel_id).select("account_id", F.lit("owner").alias("relation"), F.lit(1).cast("long").alias("weight"))
    own = videos.where(F.col("channel_id") == channel_id).select("video_id")
    counts = comments.join(own, "video_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_comments)
    return owner.unionByName(counts.select("account_id", F.lit("commenter").alias("relation"), "weight")).orderBy(F.desc("weight"), "account_id", "relation").limit(limit)
