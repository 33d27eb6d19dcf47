"""Seeded synthetic platform: base entities, planted rings and sealed labels.

All values are functions of seed and row number (hash-uniform columns over ``spark.range``), so the same
seed gives the same rows on any cluster. Distributions follow the platform's fixed means; single draws differ from
other generators'.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.operators.measurement import uniform
from ringwatch.sources.platform import BASE_MS, DAY_MS
from ringwatch.sources.threats import plant_all

#: Sizes and Poisson means at scale 1.
ACCOUNTS, CHANNELS = 400, 50
MEANS = {"video": 8.0, "comment": 15.0, "view": 50.0, "like": 12.0, "dislike": 2.0, "share": 4.0, "report": 1.0, "subscribe": 30.0}
WINDOW_DAYS, PLANTED = 730, 0.02


def poisson(u: Column, mean: float) -> Column:
    """Poisson count from a uniform number, by the inverse of its distribution."""
    total, term, cuts = 0.0, math.exp(-mean), []
    for k in range(int(mean + 8 * math.sqrt(mean)) + 8):
        total += term
        cuts.append(total)
        term *= mean / (k + 1)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= u))


def burst_instant(u: Column, inside: Column, start_ms: Column, length_ms: int, weight: float) -> Column:
    """Instant of a mixture: within the burst by ``weight``, else anywhere in the window."""
    return F.when(inside < weight, start_ms + F.floor(u * length_ms)).otherwise(BASE_MS + F.floor(u * (WINDOW_DAYS * DAY_MS))).cast("long")


def _instant(seed: str, *keys: Column) -> Column:
    return (BASE_MS + F.floor(uniform(seed, *keys) * (WINDOW_DAYS * 86_400)) * 1000).cast("long")


def _children(parents: DataFrame, key: str, seed: str, mean: float) -> DataFrame:
    n = poisson(uniform(f"{seed}:n", F.col(key)), mean)
    return parents.select(key, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("_i"))


def build(spark: SparkSession, seed: int, scale: int = 1, rings: int = 7, threats: bool = True) -> dict[str, DataFrame]:
    """The six views and ``sealed_labels``: comment rings, and with ``threats`` the other six kinds."""
    s = str(seed)
    pick = lambda what, count, *keys: F.floor(uniform(f"{s}:{what}", *keys) * count).cast("long")
    n_accounts, n_channels = ACCOUNTS * scale, CHANNELS * scale
    i = F.col("id")
    accounts = spark.range(n_accounts).select(
        F.concat(F.lit("acct_"), i).alias("account_id"), F.concat(F.lit("ipb_"), pick("ip", n_accounts // 4, i)).alias("signup_ip_bucket"), F.lit(None).cast("string").alias("device_fingerprint_hint"),
        (uniform(f"{s}:ver", i) < 0.1).alias("is_verified"), F.concat(F.lit("user "), i).alias("display_name"), _instant(f"{s}:acct", i).alias("created_ms"),
    )
    channels = spark.range(n_channels).select(
        F.concat(F.lit("chan_"), i).alias("channel_id"), F.concat(F.lit("acct_"), i).alias("account_id"), F.concat(F.lit("channel "), i).alias("display_name"), F.concat(F.lit("about "), i).alias("description")
    )
    videos = _children(channels, "channel_id", f"{s}:video", MEANS["video"])
    video_id = F.concat_ws("_", F.lit("vid"), F.substring("channel_id", 6, 20), "_i")
    u = uniform(f"{s}:prov", F.col("channel_id"), F.col("_i"))
    videos = videos.select(
        video_id.alias("video_id"), "channel_id", F.concat(F.lit("video "), "_i").alias("title"), (uniform(f"{s}:disc", F.col("channel_id"), F.col("_i")) < 0.9).alias("synthetic_media_disclosed"),
        F.when(u < 0.5, "present").when(u < 0.8, "unknown").otherwise("absent").alias("provenance_signal"), _instant(f"{s}:pub", F.col("channel_id"), F.col("_i")).alias("published_ms"),
        (30 + pick("dur", 1200, F.col("channel_id"), F.col("_i"))).alias("duration_s"),
    )
    comments = _children(videos, "video_id", f"{s}:comment", MEANS["comment"])
    v, j = F.col("video_id"), F.col("_i")
    comments = comments.select(
        F.concat_ws("_", F.lit("cmt"), F.substring("video_id", 5, 40), "_i").alias("comment_id"), "video_id", F.concat(F.lit("acct_"), pick("by", n_accounts, v, j)).alias("account_id"),
        _instant(f"{s}:said", v, j).alias("posted_ms"), F.lit(None).cast("string").alias("template_id"), F.concat(F.lit("comment "), "_i").alias("text"),
    )
    events = None
    for kind, mean in list(MEANS.items())[2:]:
        key = "channel_id" if kind == "subscribe" else "video_id"
        rows = _children(channels if kind == "subscribe" else videos, key, f"{s}:{kind}", mean)
        k = F.col(key)
        rows = rows.select(
            F.concat_ws("_", F.lit("ev"), F.lit(kind), k, "_i").alias("event_id"), F.concat(F.lit("acct_"), pick(f"{kind}:by", n_accounts, k, j)).alias("account_id"), F.lit(kind).alias("kind"),
            (F.lit(None).cast("string") if kind == "subscribe" else k).alias("video_id"), (k if kind == "subscribe" else F.lit(None).cast("string")).alias("channel_id"), _instant(f"{s}:{kind}:at", k, j).alias("ts_ms"),
        )
        events = rows if events is None else events.unionByName(rows)

    # Planted comment rings: accounts that share a device post one template in a burst on one video.
    size = max(1, int(n_accounts * PLANTED / rings))
    ring = (i / size).cast("int")
    members = spark.range(rings * size).select(i.alias("m"), ring.alias("ring"), F.concat(F.lit("acct_r"), ring, F.lit("_"), i).alias("account_id"))
    ring_id = F.concat(F.lit("ring_"), "ring")
    accounts = accounts.unionByName(members.select("account_id", F.concat(F.lit("ipb_r"), "ring").alias("signup_ip_bucket"), F.concat(F.lit("dev_r"), "ring").alias("device_fingerprint_hint"), F.lit(False).alias("is_verified"), F.concat(F.lit("user r"), "m").alias("display_name"), _instant(f"{s}:racct", F.col("m")).alias("created_ms")))
    target = F.broadcast(videos.orderBy(F.md5(F.concat(F.lit(f"{s}:target"), "video_id"))).limit(rings).select("video_id", F.col("published_ms").alias("_pub")).withColumn("ring", (F.row_number().over(_by_video()) - 1).cast("int")))  # a row a ring
    planted = members.join(target, "ring").withColumn("_u", uniform(f"{s}:rburst", F.col("m"))).withColumn("_w", uniform(f"{s}:rin", F.col("m")))
    planted = planted.select(
        F.concat(F.lit("cmt_r"), "m").alias("comment_id"), "video_id", "account_id", burst_instant(F.col("_u"), F.col("_w"), F.col("_pub"), 3_600_000, 0.9).alias("posted_ms"), F.concat(F.lit("tmpl_r"), "ring").alias("template_id"),
        F.lit("great offer, see profile").alias("text"), ring_id.alias("_ring"),
    )
    comments = comments.unionByName(planted.drop("_ring"))
    hints = members.select(F.concat(F.lit("hint_r"), "m").alias("hint_id"), F.lit("account").alias("subject_kind"), F.col("account_id").alias("subject_id"), F.lit("shared_device").alias("signal_type"), F.concat(F.lit("dev_r"), "ring").alias("signal_value"), _instant(f"{s}:rhint", F.col("m")).alias("observed_ms"))

    def labels(kind: str, df: DataFrame, key: str, marked: DataFrame) -> DataFrame:
        bad = marked.select(F.col("entity_id").alias(key), F.col("ring").alias("_r"))
        return df.join(bad, key, "left").select(F.lit(kind).alias("entity_kind"), F.col(key).alias("entity_id"), F.when(F.col("_r").isNull(), "benign").otherwise("t01").alias("threat_class"), F.col("_r").alias("ring_id"))

    of_accounts, of_comments = members.select(F.col("account_id").alias("entity_id"), ring_id.alias("ring")), planted.select(F.col("comment_id").alias("entity_id"), F.col("_ring").alias("ring"))
    none = of_accounts.limit(0)
    sealed = labels("account", accounts, "account_id", of_accounts).unionByName(labels("channel", channels, "channel_id", none)).unionByName(labels("video", videos, "video_id", none)).unionByName(labels("comment", comments, "comment_id", of_comments))
    views = {"account_meta": accounts, "channel": channels, "video": videos, "comment": comments, "engagement_event": events, "infra_hint": hints, "sealed_labels": sealed}
    return plant_all(views, seed) if threats else views


def _by_video():
    from pyspark.sql.window import Window

    return Window.orderBy("video_id")
