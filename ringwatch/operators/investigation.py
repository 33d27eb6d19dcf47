"""Investigations of many subjects at once: the traversal's state is a table, and every wave of hops a few joins.

A subject's work list holds each entity of its pack with each pivot its kind offers, in order of (hop, entity, pivot). Hop h works on item h. What a hop
finds is appended behind everything already listed, so the items known at some moment never change place: all of them can run at once. A wave
runs, for all subjects together, every listed item that has not run yet; a budget of 20 hops takes two or three waves however many
subjects there are. Pivots are worked out once a (pivot, entity), cut to their limit by a window over the entity, and handed to every subject
that asked. An item past the end of a list would repeat the last one and find nothing new, so it is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.operators.graph import BUDGETS, OFFERS, RECOVERABLE, rings
from ringwatch.sources.scratch import stored

_COLUMNS = ["subject", "row", "node_id", "kind"]


def _cut(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows of each subject's pivot, numbered."""
    return df.withColumn("row", F.row_number().over(Window.partitionBy("subject").orderBy(*order))).where(F.col("row") <= limit)


def _own_videos(p, who: DataFrame) -> DataFrame:
    """Videos of the channels asked for, stored: Spark then knows that they are few, and large tables need not be dealt out to meet them."""
    return stored(p.video.join(who, "channel_id", "left_semi").select("video_id", F.col("channel_id").alias("subject")), "videos")


def account_links(p, subjects: DataFrame, limit: int) -> DataFrame:
    """Owners and commenters of channels."""
    who = subjects.select(F.col("subject").alias("channel_id"))
    owner = p.channel.join(who, "channel_id", "left_semi").select(F.col("channel_id").alias("subject"), "account_id", F.lit("owner").alias("relation"), F.lit(1).cast("long").alias("weight"))
    own = _own_videos(p, who)
    said = p.comments_among(own.select("video_id")).join(own, "video_id").groupBy("subject", "account_id").agg(F.count(F.lit(1)).alias("weight")).select("subject", "account_id", F.lit("commenter").alias("relation"), "weight")
    return _cut(owner.unionByName(said), [F.desc("weight"), "account_id", "relation"], limit).select("subject", "row", F.col("account_id").alias("node_id"), F.lit("account").alias("kind"))


def engagement_edges(p, subjects: DataFrame, limit: int) -> DataFrame:
    """Who engaged with channels or their videos, and with which videos."""
    who = subjects.select(F.col("subject").alias("channel_id"))
    own = _own_videos(p, who)
    events = p.engagement_event
    on_video = events.join(own, "video_id").select("subject", "account_id", F.lit("video").alias("target_kind"), F.col("video_id").alias("target_id"), "kind")
    on_channel = events.join(who, "channel_id", "left_semi").select(F.col("channel_id").alias("subject"), "account_id", F.lit("channel").alias("target_kind"), F.col("channel_id").alias("target_id"), "kind")
    counted = on_video.unionByName(on_channel).groupBy("subject", "account_id", "target_kind", "target_id", F.col("kind").alias("event")).agg(F.count(F.lit(1)).alias("n"))
    first = _cut(counted, [F.desc("n"), "account_id", "target_id", "event"], limit)
    video = F.when(F.col("target_kind") == "video", F.struct(F.col("target_id").alias("node_id"), F.lit("video").alias("kind")))
    each = F.explode(F.array_compact(F.array(F.struct(F.col("account_id").alias("node_id"), F.lit("account").alias("kind")), video)))
    return first.select("subject", "row", each.alias("x")).select("subject", "row", "x.*")


def infra_overlaps(p, subjects: DataFrame, limit: int) -> DataFrame:
    """Entities that share a signal value; no subject can need more than the first ``limit`` holders of a value besides itself."""
    hints = p.infra_hint.select("subject_id", "subject_kind", "signal_type", "signal_value").distinct()
    turn = Window.partitionBy("signal_type", "signal_value").orderBy("subject_id", "subject_kind")
    first = hints.withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= limit + 1)
    own = hints.join(subjects.select(F.col("subject").alias("subject_id")), "subject_id", "left_semi").select(F.col("subject_id").alias("subject"), "signal_type", "signal_value").distinct()
    peers = own.join(first, ["signal_type", "signal_value"]).where("subject_id <> subject")
    return _cut(peers, ["signal_type", "subject_id", "signal_value", "subject_kind"], limit).select("subject", "row", F.col("subject_id").alias("node_id"), F.col("subject_kind").alias("kind"))


def shared_metadata(p, subjects: DataFrame, limit: int) -> DataFrame:
    """Accounts with an account's sign-up bucket or device hint; the first ``limit`` of each value besides itself suffice."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("device_fingerprint_hint", "signup_ip_bucket")]))
    held = p.account_meta.select("account_id", fields.alias("x")).select("account_id", "x.*").where("value is not null")
    first = held.withColumn("_n", F.row_number().over(Window.partitionBy("field", "value").orderBy("account_id"))).where(F.col("_n") <= limit + 1)
    own = held.join(subjects.select(F.col("subject").alias("account_id")), "account_id", "left_semi").withColumnRenamed("account_id", "subject")
    peers = own.join(first, ["field", "value"]).where("account_id <> subject")
    return _cut(peers, ["field", "account_id"], limit).select("subject", "row", F.col("account_id").alias("node_id"), F.lit("account").alias("kind"))


PIVOTS = {"account_link": account_links, "engagement_edge": engagement_edges, "infra_overlap": infra_overlaps, "shared_metadata": shared_metadata}


def work_list(nodes: DataFrame, budget: int) -> DataFrame:
    """(seed, hop_index, pivot, subject): the first ``budget`` items of every seed's list."""
    rows = [(kind, pivot, i) for kind, offered in OFFERS.items() for i, pivot in enumerate(offered)]
    offers = F.broadcast(nodes.sparkSession.createDataFrame(rows, "kind string, pivot_kind string, turn int"))  # a few rows
    order = Window.partitionBy("seed").orderBy("hop_index", "node_id", "turn")
    listed = nodes.join(offers, "kind").withColumn("item", F.row_number().over(order)).where(F.col("item") <= budget)
    return listed.select("seed", F.col("item").alias("hop_index"), "pivot_kind", F.col("node_id").alias("subject"))


def explore(platform, seeds: DataFrame, budget: int = 20, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(seed, node_id, kind, hop_index) of every pack, and its hops (seed, hop_index, pivot, subject, row_count). ``seeds``: seed, node_id, kind."""
    start = stored(seeds.select("seed", "node_id", "kind", F.lit(0).alias("hop_index")), "nodes")
    nodes, hops = start, None
    while True:
        work = work_list(nodes, budget)
        new = stored(work if hops is None else work.join(hops.select("seed", "hop_index"), ["seed", "hop_index"], "left_anti"), "work")
        if new.isEmpty():
            return nodes, hops if hops is not None else new.withColumn("row_count", F.lit(0).cast("long"))
        found = []
        for pivot, run in PIVOTS.items():
            items = new.where(F.col("pivot_kind") == pivot)
            rows = run(platform, items.select("subject").distinct(), limit)
            found.append(items.join(rows, "subject").select("seed", "hop_index", "pivot_kind", "subject", "row", "node_id", "kind"))
        rows = stored(reduce(DataFrame.unionByName, found), "rows")
        counts = rows.groupBy("seed", "hop_index").agg(F.count_distinct("row").alias("row_count"))
        ran = new.join(counts, ["seed", "hop_index"], "left").fillna(0, ["row_count"])
        hops = stored(ran if hops is None else hops.unionByName(ran.select(*hops.columns)), "hops")
        both = nodes.unionByName(rows.select(*nodes.columns))
        nodes = stored(both.groupBy("seed", "node_id").agg(F.min_by("kind", "hop_index").alias("kind"), F.min("hop_index").alias("hop_index")), "nodes")


def ring_members(platform) -> DataFrame:
    """Members of all rings, worked out once and stored."""
    return stored(rings(platform.labels), "members")


def _homes(platform, few: DataFrame) -> DataFrame:
    """(ring_id, entity_id, channel_id) of videos and comments. Lines are cut down to these comments before they meet anything."""
    video = platform.video.select("video_id", "channel_id")
    of_video = few.where("entity_kind = 'video'").join(video, F.col("entity_id") == F.col("video_id"))
    ids = few.where("entity_kind = 'comment'").select("ring_id", "entity_id")
    said = stored(platform.comments_among(ids.select(F.col("entity_id").alias("comment_id"))).select("comment_id", "video_id"), "said").join(video, "video_id")
    of_comment = ids.join(said, F.col("entity_id") == F.col("comment_id"))
    return of_video.select("ring_id", "entity_id", "channel_id").unionByName(of_comment.select("ring_id", "entity_id", "channel_id"))


def ring_seeds(platform, members: DataFrame | None = None, least: int = 64) -> DataFrame:
    """Where a ring's investigation starts: the channel of its least member.

    Only the least members of a ring are looked up; rings none of whose have a channel go on with 16 times as many, to their last member.
    """
    members = (ring_members(platform) if members is None else members).select("ring_id", "entity_kind", "entity_id").where("entity_id is not null").distinct()
    turn, found = Window.partitionBy("ring_id").orderBy("entity_id"), None
    while True:
        few = stored(members.withColumn("_n", F.dense_rank().over(turn)).where(F.col("_n") <= least), "least")
        first = _homes(platform, few).groupBy("ring_id").agg(F.min(F.struct("entity_id", "channel_id")).alias("x"))
        first = stored(first.select(F.col("ring_id").alias("seed"), F.col("x.channel_id").alias("node_id"), F.lit("channel").alias("kind")), "seeds")
        found = first if found is None else found.unionByName(first)
        open_ = few.where(F.col("_n") == least).select("ring_id").distinct().join(first.select(F.col("seed").alias("ring_id")), "ring_id", "left_anti")
        if open_.isEmpty():
            return found
        members, least = stored(members.join(open_, "ring_id", "left_semi"), "members"), 16 * least


def recovered(nodes: DataFrame, members: DataFrame, seeds: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """Of each ring and budget: other members, those a pack can hold, those found, and both shares.

    ``members``: ring_id, threat_class, entity_kind, entity_id; a ring's class is the first of its members' by name.
    """
    kinds = members.groupBy("ring_id").agg(F.min("threat_class").alias("threat_class"))
    others = members.select("ring_id", "entity_kind", "entity_id").distinct().join(seeds.select(F.col("seed").alias("ring_id"), F.col("node_id").alias("entity_id")), ["ring_id", "entity_id"], "left_anti")
    seen = others.join(nodes.select(F.col("seed").alias("ring_id"), F.col("node_id").alias("entity_id"), "hop_index"), ["ring_id", "entity_id"], "left")
    each = seen.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    hit = F.coalesce(F.col("hop_index") <= F.col("budget"), F.lit(False))
    out = each.groupBy("ring_id", "budget").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("entity_kind").isin(*RECOVERABLE)).alias("reachable"), F.count_if(hit).alias("found"))
    share = lambda n: F.when(F.col(n) > 0, F.col("found") / F.col(n)).otherwise(0.0)
    return out.join(kinds, "ring_id").select("ring_id", "threat_class", "budget", "members", "reachable", "found", share("members").alias("recovery"), share("reachable").alias("of_reachable"))


def mean_recovery(results: DataFrame) -> DataFrame:
    """Mean shares of each class and budget over its rings."""
    return results.groupBy("threat_class", "budget").agg(F.count(F.lit(1)).alias("cases"), F.avg("recovery").alias("recovery"), F.avg("of_reachable").alias("of_reachable"))
