"""Evidence graph: rows of pivots as nodes, edges and events, hop folds, ring recovery.

A pack is four DataFrames. A hop's records are added once: an id the pack has already keeps its
first provenance, and of equal ids in one hop the first in row order stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.operators import pivots
from ringwatch.operators.ledger import canonical

RECOVERABLE, BUDGETS = ("account", "channel", "video"), (5, 10, 20)
#: Which pivots each kind of entity offers, in order.
OFFERS = {"channel": ("account_link", "engagement_edge", "infra_overlap"), "account": ("infra_overlap", "shared_metadata"), "video": (), "comment": ()}
#: The order of each pivot's rows; a minus marks a descending column.
ORDERS = {
    "shared_metadata": ("metadata_field", "peer_account_id"), "temporal_correlation": ("posted_ms", "comment_id"), "engagement_edge": ("-event_count", "account_id", "target_id", "kind"),
    "infra_overlap": ("signal_type", "peer_id", "signal_value", "peer_kind"), "account_link": ("-weight", "account_id", "relation"),
}
RELATIONS = ("owns", "linked_to", "published_on", "commented_on", "engaged_with", "shares_infra_signal", "shares_metadata")
NODE = "node_id string, kind string, hop_index int"
EDGE = "edge_id string, source_id string, target_id string, relation string, hop_index int"
EVENT = "event_id string, kind string, node_id string, ts_ms long, hop_index int"
PROVENANCE = "hop_index int, pivot string, subject string, param_hash string, row_count long"


@dataclass(frozen=True)
class Pack:
    nodes: DataFrame
    edges: DataFrame
    events: DataFrame
    provenance: DataFrame


def seed(spark: SparkSession, node_id: str, kind: str) -> Pack:
    return Pack(
        spark.createDataFrame([(node_id, kind, 0)], NODE), spark.createDataFrame([], EDGE), spark.createDataFrame([], EVENT),
        spark.createDataFrame([(0, None, node_id, canonical(["seed", node_id]), 1)], PROVENANCE),
    )


def edge_id(relation: Column, source: Column, target: Column, mark: Column | None = None) -> Column:
    return F.concat_ws(":", F.lit("edge"), relation, source, target, *([mark] if mark is not None else []))


def _node(node: Column, kind: str | Column) -> Column:
    return F.struct(node.alias("node_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))


def _edge(source: Column, target: Column, relation: str, mark: Column | None = None) -> Column:
    r = F.lit(relation)
    return F.struct(edge_id(r, source, target, mark).alias("edge_id"), source.alias("source_id"), target.alias("target_id"), r.alias("relation"))


def _event(name: Column, kind: str, node: Column, ms: Column) -> Column:
    return F.struct(name.alias("event_id"), F.lit(kind).alias("kind"), node.alias("node_id"), ms.cast("long").alias("ts_ms"))


def mapped(pivot: str, subject: str) -> tuple[list[Column], list[Column], list[Column]]:
    """What one row of a pivot adds: nodes, edges, events, in order."""
    c, s = F.col, F.lit(subject)
    if pivot == "shared_metadata":
        return [_node(c("peer_account_id"), "account")], [_edge(s, c("peer_account_id"), "shares_metadata", c("metadata_field"))], []
    if pivot == "temporal_correlation":
        return (
            [_node(c("video_id"), "video"), _node(c("account_id"), "account")], [_edge(s, c("video_id"), "published_on"), _edge(c("account_id"), c("video_id"), "commented_on")],
            [_event(F.concat_ws(":", F.lit("ev:comment"), "comment_id"), "comment_posted", c("account_id"), c("posted_ms"))],
        )
    if pivot == "engagement_edge":
        on_video = c("target_kind") == "video"
        return (
            [_node(c("account_id"), "account"), F.when(on_video, _node(c("target_id"), "video"))],
            [F.when(on_video, _edge(s, c("target_id"), "published_on")), _edge(c("account_id"), c("target_id"), "engaged_with", c("kind"))],
            [_event(F.concat_ws(":", F.lit("ev:engagement"), "account_id", "target_id", "kind"), "engagement_observed", c("account_id"), c("first_ms"))],
        )
    if pivot == "infra_overlap":
        return (
            [_node(c("peer_id"), c("peer_kind"))], [_edge(s, c("peer_id"), "shares_infra_signal", c("signal_type"))],
            [_event(F.concat_ws(":", F.lit("ev:signal"), "peer_id", "signal_type", "signal_value"), "signal_observed", c("peer_id"), c("first_ms"))],
        )
    relation = F.when(c("relation") == "owner", _edge(c("account_id"), s, "owns")).otherwise(_edge(c("account_id"), s, "linked_to"))
    return [_node(c("account_id"), "account")], [relation], []


def first_wins(new: DataFrame, old: DataFrame, key: str, order: str) -> DataFrame:
    """New records whose id ``old`` lacks, the first of each id."""
    turn = Window.partitionBy(key).orderBy(order)
    return new.withColumn("_n", F.row_number().over(turn)).where("_n = 1").drop("_n", order).join(old.select(key).distinct(), key, "left_anti")


def fold(pack: Pack, pivot: str, subject: str, rows: DataFrame, hop: int, param_hash: str) -> Pack:
    """The pack after a hop. ``rows`` are in the pivot's order and at most its limit."""
    order = Window.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in ORDERS[pivot]])  # at most 200 rows
    numbered = rows.withColumn("_row", F.row_number().over(order))
    out = {}
    for name, key, structs in zip(("nodes", "edges", "events"), ("node_id", "edge_id", "event_id"), mapped(pivot, subject), strict=True):
        old = getattr(pack, name)
        if not structs:
            out[name] = old
            continue
        each = numbered.select("_row", F.posexplode(F.array(*structs)).alias("_i", "x")).where("x is not null")
        new = each.select("x.*", (F.col("_row") * 8 + F.col("_i")).alias("_ord"))
        out[name] = old.unionByName(first_wins(new, old, key, "_ord").withColumn("hop_index", F.lit(hop)).select(*old.columns))
    entry = rows.sparkSession.range(1).crossJoin(rows.agg(F.count(F.lit(1)).alias("row_count"))).select(F.lit(hop).alias("hop_index"), F.lit(pivot).alias("pivot"), F.lit(subject).alias("subject"), F.lit(param_hash).alias("param_hash"), "row_count")
    return replace(pack, **out, provenance=pack.provenance.unionByName(entry))


def execute(platform, pivot: str, subject: str, limit: int = 25, anchor_ms: int = 0, hours: int = pivots.MAX_HOURS) -> DataFrame:
    """A pivot on a subject with the traversal's standing parameters; the instant matters to ``temporal_correlation`` alone."""
    p = platform
    runs: dict[str, Callable[[], DataFrame]] = {
        "account_link": lambda: pivots.account_link(p.channel, p.comment, p.video, subject, 1, limit),
        "engagement_edge": lambda: pivots.engagement_edge(p.engagement_event, p.video, subject, "any", 1, limit),
        "infra_overlap": lambda: pivots.infra_overlap(p.infra_hint, subject, limit),
        "shared_metadata": lambda: pivots.shared_metadata(p.account_meta, subject, "any", limit),
        "temporal_correlation": lambda: pivots.temporal_correlation(p.comment, p.video, subject, anchor_ms, hours, limit),
    }
    return runs[pivot]()


def investigate(platform, subject: str, kind: str, budget: int, limit: int = 25, most: int = 20) -> Pack:
    """Works through the pack's entities in order, one pivot a hop, until the budget is spent.

    The pack is bounded by budget times limit, so its work list may reach the driver; every hop is written out
    to end its lineage.
    """
    if budget > most:
        raise ValueError(f"at most {most} hops")
    pack = seed(platform.spark, subject, kind)
    for hop in range(1, budget + 1):
        listed = pack.nodes.select("node_id", "kind", "hop_index").orderBy("hop_index", "node_id").collect()
        work = [(p, r["node_id"]) for r in listed for p in OFFERS[r["kind"]]]
        pivot, target = work[min(hop - 1, len(work) - 1)]
        pack = fold(pack, pivot, target, execute(platform, pivot, target, limit), hop, canonical([pivot, f"limit=int:{limit}", f"subject=str:{target}"]))
        if hop % 4 == 0:
            pack = Pack(*[x.checkpoint() if platform.spark.sparkContext.getCheckpointDir() else x for x in (pack.nodes, pack.edges, pack.events, pack.provenance)])
    return pack


def frontier(platform, nodes: DataFrame, limit: int = 25) -> DataFrame:
    """One hop of infrastructure overlap from all entities at once: the best ``limit`` peers of each.

    The set-based form of the loop: holders are counted for each value before values meet subjects, and no subject needs more
    than the first ``limit`` holders of a value besides itself.
    """
    hints = platform.infra_hint.groupBy("subject_id", "subject_kind", "signal_type", "signal_value").agg(F.count(F.lit(1)).alias("n"))
    own = hints.join(nodes.select(F.col("node_id").alias("subject_id")), "subject_id", "left_semi").select("signal_type", "signal_value", F.col("subject_id").alias("source_id"), F.col("n").alias("own"))
    first = hints.withColumn("_n", F.dense_rank().over(Window.partitionBy("signal_type", "signal_value").orderBy("subject_id"))).where(F.col("_n") <= limit + 1).drop("_n")
    peers = own.join(first, ["signal_type", "signal_value"]).where("subject_id <> source_id")
    order = Window.partitionBy("source_id").orderBy("signal_type", "subject_id", "signal_value")
    return peers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("source_id", F.col("subject_id").alias("peer_id"), "signal_type", "signal_value", (F.col("own") * F.col("n")).alias("hint_count"))


def violations(pack: Pack) -> DataFrame:
    """Everything wrong with a pack: loose edges and events, self edges, gaps in hops, duplicate ids."""
    ids = pack.nodes.select("node_id")
    loose = lambda side: pack.edges.join(ids, pack.edges[side] == ids["node_id"], "left_anti").select(F.lit(f"loose_{side}").alias("code"), F.col("edge_id").alias("subject"))
    twice = lambda df, key: df.groupBy(key).count().where("count > 1").select(F.lit("duplicate_id").alias("code"), F.col(key).alias("subject"))
    gaps = pack.provenance.agg(F.count(F.lit(1)).alias("n"), F.max("hop_index").alias("m")).where("n <> m + 1").select(F.lit("hop_gap").alias("code"), F.col("m").cast("string").alias("subject"))
    parts = [
        loose("source_id"), loose("target_id"), pack.events.join(ids, "node_id", "left_anti").select(F.lit("loose_event").alias("code"), F.col("event_id").alias("subject")),
        pack.edges.where("source_id = target_id").select(F.lit("self_edge").alias("code"), F.col("edge_id").alias("subject")), twice(pack.nodes, "node_id"), twice(pack.edges, "edge_id"), gaps,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unknown_relations(pack: Pack) -> DataFrame:
    """Edges of a relation that no pivot makes."""
    return pack.edges.where(~F.col("relation").isin(*RELATIONS)).select(F.lit("unknown_relation").alias("code"), F.col("edge_id").alias("subject"))


def rings(labels: DataFrame) -> DataFrame:
    """Members of each planted ring."""
    return labels.where("ring_id is not null").select("ring_id", "threat_class", "entity_kind", "entity_id").distinct()


def recovery(nodes: DataFrame, members: DataFrame, seeds: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """Share of each ring found within each budget, of all members and of those a pivot can reach.

    ``nodes`` have ring_id, node_id and hop_index (a pack for each ring); the seed itself counts nowhere.
    """
    others = members.join(seeds.select("ring_id", F.col("node_id").alias("entity_id")), ["ring_id", "entity_id"], "left_anti")
    seen = others.join(nodes.groupBy("ring_id", F.col("node_id").alias("entity_id")).agg(F.min("hop_index").alias("hop")), ["ring_id", "entity_id"], "left")
    each = seen.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    reach, hit = F.col("entity_kind").isin(*RECOVERABLE), F.col("hop") <= F.col("budget")
    out = each.groupBy("ring_id", "budget").agg(F.count(F.lit(1)).alias("members"), F.count_if(reach).alias("reachable"), F.count_if(F.coalesce(hit, F.lit(False))).alias("found"))
    return out.withColumn("recovery", F.col("found") / F.col("members"))


