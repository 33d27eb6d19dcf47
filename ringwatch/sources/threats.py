"""Planted threats: six kinds of rings as set-based generators, each within a budget of labelled entities.

A kind is a shape: how many rings, members a ring, what each member owns and says, what the members share, and how they act on one another. A
ring's members are rows of one range; everything else is derived from them by columns and joins on the ring. Accounts, channels, videos and
comments are labelled and count against the budget; engagement and hints are not. A shape over budget gives up comments, then videos, then members, then rings,
down to its least form. All values are functions of seed, kind, ring and member.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.operators.measurement import uniform
from ringwatch.sources.platform import BASE_MS, DAY_MS

#: The share of entities that may be abusive, the kinds it is shared by, the length of the window, how often an act falls in its ring's burst.
FRACTION, KINDS, WINDOW_DAYS, IN_BURST = 0.02, 7, 730, 0.9


@dataclass(frozen=True)
class Shape:
    rings: int
    members: int
    hours: int
    channel: bool = True
    videos: int = 0
    comments: int = 0
    least_members: int = 1
    least_comments: int = 0
    one_ip: bool = False
    one_device: bool = False
    signal: tuple[str, str] | None = None  # signal type, kind of its subject
    value: str = ""
    acts: tuple[str, ...] = ()  # of every member on every other's channel or video
    provenance: str = "unknown"
    template: bool = False

    def size(self) -> int:
        """Labelled entities of all rings."""
        return self.rings * self.members * (1 + self.channel + self.videos + self.comments)

    def within(self, budget: int) -> Shape:
        """The shape, made smaller until it fits; its least form may still not."""
        shape = self
        while shape.size() > budget:
            if shape.comments > shape.least_comments:
                shape = replace(shape, comments=shape.comments - 1)
            elif shape.videos > 1:
                shape = replace(shape, videos=shape.videos - 1)
            elif shape.members > shape.least_members:
                shape = replace(shape, members=shape.members - 1)
            elif shape.rings > 1:
                shape = replace(shape, rings=shape.rings - 1)
            else:
                break
        return shape


#: The shape of each kind.
SHAPES = {
    "t02": Shape(2, 3, 2, videos=1, one_ip=True, one_device=True, acts=("subscribe", "view", "like")),
    "t03": Shape(2, 3, 4, channel=False, comments=2, signal=("link_domain_reuse", "account"), value="prize-claim"),
    "t04": Shape(2, 1, 6, videos=3, provenance="absent"),
    "t05": Shape(2, 1, 6, videos=3, provenance="absent"),
    "t06": Shape(1, 3, 8, videos=2, signal=("shared_upload_pattern", "channel"), value="upload"),
    "t07": Shape(1, 3, 5, videos=1, comments=1, least_members=2, least_comments=1, one_ip=True, signal=("shared_ip_bucket", "account"), value="ipb", acts=("view",), template=True),
}
VIEWS = ("account_meta", "channel", "video", "comment", "engagement_event", "infra_hint", "sealed_labels")


def class_budget(entities: int, fraction: float = FRACTION, kinds: int = KINDS) -> int:
    """Entities one kind may plant beside ``entities`` of the base population; one at least."""
    return max(1, int(entities * fraction / kinds))


def _moment(seed: str, shape: Shape, *keys: Column) -> Column:
    """An instant of the ring's burst, or now and then of the whole window."""
    whole = WINDOW_DAYS * DAY_MS
    start = F.floor(uniform(f"{seed}:burst", F.col("ring")) * (whole - shape.hours * 3_600_000))
    inside = start + F.floor(uniform(f"{seed}:at", *keys) * (shape.hours * 3_600_000))
    return (BASE_MS + F.when(uniform(f"{seed}:in", *keys) < IN_BURST, inside).otherwise(F.floor(uniform(f"{seed}:off", *keys) * whole))).cast("long")


def plant(spark: SparkSession, kind: str, shape: Shape, seed: str, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows a kind adds to each view. Comments of a kind without videos go to ``targets`` (video_id), others to the next member's video."""
    s, c = f"{seed}:{kind}", F.col
    name = lambda what, *parts: F.concat_ws("_", F.lit(f"{kind}_{what}"), *parts)
    m = spark.range(shape.rings * shape.members).select((c("id") / shape.members).cast("int").alias("ring"), (c("id") % shape.members).cast("int").alias("m"))
    m = m.select("*", name("acct", "ring", "m").alias("account_id"), name("chan", "ring", "m").alias("channel_id"), F.concat_ws("_", F.lit("ring"), F.lit(kind), "ring").alias("ring_id"))
    who = lambda shared: name("ip", "ring") if shared else name("ip", "ring", "m")
    accounts = m.select(
        "account_id", who(shape.one_ip).alias("signup_ip_bucket"), (name("dev", "ring") if shape.one_device else F.lit(None).cast("string")).alias("device_fingerprint_hint"), F.lit(False).alias("is_verified"),
        F.concat(F.lit("user "), "account_id").alias("display_name"), _moment(f"{s}:acct", shape, c("ring"), c("m")).alias("created_ms"),
    )
    channels = m.select("channel_id", "account_id", F.concat(F.lit("channel "), "channel_id").alias("display_name"), F.concat(F.lit("about "), "channel_id").alias("description"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>"))
    videos = m.select("*", each(shape.videos).alias("v")).withColumn("video_id", name("vid", "ring", "m", "v"))
    said = m.select("*", each(shape.comments).alias("v")).withColumn("comment_id", name("cmt", "ring", "m", "v"))
    if shape.videos:
        near = m.select("ring", ((c("m") + shape.members - 1) % shape.members).alias("m"), name("vid", "ring", "m", F.lit(0)).alias("video_id"))
        said = said.join(near, ["ring", "m"])
    elif targets is not None:
        most = max(1, shape.rings * shape.members * shape.comments)
        few = targets.select("video_id").orderBy(F.md5(F.concat(F.lit(f"{s}:target"), "video_id")), "video_id").limit(most)
        few = few.withColumn("_i", F.row_number().over(Window.orderBy("video_id")) - 1)  # a comment's worth each
        place = (c("ring") * shape.members + c("m")) * max(1, shape.comments) + c("v")
        said = said.withColumn("_i", place % max(1, few.count())).join(few, "_i").drop("_i")
    own = f"{kind}_tmpl" if shape.template else None
    comments = said.select(
        "comment_id", "video_id", "account_id", _moment(f"{s}:said", shape, c("ring"), c("m"), c("v")).alias("posted_ms"), (F.concat_ws("_", F.lit(own), "ring") if own else F.lit(None).cast("string")).alias("template_id"),
        F.concat_ws(" ", F.lit("see"), F.concat(F.lit(shape.value), F.lit("-"), "ring", F.lit(".example")) if not shape.videos else F.lit("my channel for the real story")).alias("text"),
    ) if shape.comments else None
    others = m.select("ring", c("m").alias("o"), c("channel_id").alias("other_channel"), name("vid", "ring", "m", F.lit(0)).alias("other_video"))
    acts = m.join(others, "ring").where("m <> o").select("*", F.explode(F.array(*map(F.lit, shape.acts)) if shape.acts else F.array().cast("array<string>")).alias("kind"))
    on_channel = c("kind") == "subscribe"
    events = acts.select(
        name("ev", "ring", "m", "o", "kind").alias("event_id"), "account_id", "kind", F.when(~on_channel, c("other_video")).alias("video_id"), F.when(on_channel, c("other_channel")).alias("channel_id"),
        _moment(f"{s}:act", shape, c("ring"), c("m"), c("o"), c("kind")).alias("ts_ms"),
    )
    out = {
        "account_meta": accounts, "engagement_event": events, "comment": comments, "channel": channels if shape.channel else None,
        "video": videos.select(
            "video_id", "channel_id", F.concat(F.lit("video "), "video_id").alias("title"), F.lit(False).alias("synthetic_media_disclosed"), F.lit(shape.provenance).alias("provenance_signal"),
            _moment(f"{s}:pub", shape, c("ring"), c("m"), c("v")).alias("published_ms"), F.lit(300).cast("long").alias("duration_s"),
        ) if shape.videos else None,
    }
    if shape.signal:
        signal, subject = shape.signal
        out["infra_hint"] = m.select(
            name("hint", "ring", "m").alias("hint_id"), F.lit(subject).alias("subject_kind"), c(f"{subject}_id").alias("subject_id"), F.lit(signal).alias("signal_type"),
            (who(True) if shape.value == "ipb" else F.concat_ws("_", F.lit(f"{kind}_{shape.value}"), "ring")).alias("signal_value"), _moment(f"{s}:seen", shape, c("ring"), c("m")).alias("observed_ms"),
        )
    marked = [("account", m, "account_id", True), ("channel", m, "channel_id", shape.channel), ("video", videos, "video_id", shape.videos), ("comment", said, "comment_id", shape.comments)]
    labels = None
    for entity, df, key, there in marked:
        if there:
            rows = df.select(F.lit(entity).alias("entity_kind"), c(key).alias("entity_id"), F.lit(kind).alias("threat_class"), "ring_id")
            labels = rows if labels is None else labels.unionByName(rows)
    return {k: v for k, v in (out | {"sealed_labels": labels}).items() if v is not None}


def plant_all(views: dict[str, DataFrame], seed: int, fraction: float = FRACTION) -> dict[str, DataFrame]:
    """``views`` with every kind planted; the budget follows the labelled base entities."""
    spark = views["account_meta"].sparkSession
    base = sum(views[v].count() for v in ("account_meta", "channel", "video", "comment"))
    out = dict(views)
    for kind, shape in SHAPES.items():
        for view, rows in plant(spark, kind, shape.within(class_budget(base, fraction)), str(seed), views["video"]).items():
            out[view] = out[view].unionByName(rows.select(*out[view].columns))
    return out
