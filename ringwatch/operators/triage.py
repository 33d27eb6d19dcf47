"""Flagged channels: signals, bursts, score components and the ranked queue.

Each component is one aggregate over the whole platform, keyed by channel; the queue joins them.
Signal values are reduced to their distinct holders and days before they meet channels, so a
popular value costs one row, not one a pair of holders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.sources.platform import DAY_MS, FINER
from ringwatch.sources.scratch import stored

#: Severity of each signal, and of what aggravates a flagged channel.
SEVERITY = {"link_domain_reuse": 1.0, "shared_device": 0.8, "shared_ip_bucket": 0.6, "template_reuse": 0.5, "shared_upload_pattern": 0.4}
UNDISCLOSED, TEMPLATED = 0.3, 0.5
#: Weights of the priority, and where components saturate.
WEIGHTS = {"severity_class": 0.40, "spread": 0.25, "velocity": 0.20, "recidivism": 0.15}
SPREAD_CAP, RECIDIVISM_CAP, COORDINATION_FLOOR, QUEUE = 12, 4, 2, 25
IST_MS = 19_800_000  # +05:30


def undisclosed(videos: DataFrame) -> DataFrame:
    return videos.where(~F.col("synthetic_media_disclosed")).groupBy("channel_id").agg(F.count(F.lit(1)).alias("undisclosed_videos"))


def on_channels(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Comments with the channel they were posted on."""
    return comments.join(videos.select("video_id", "channel_id"), "video_id")


def templated(comments: DataFrame, videos: DataFrame) -> DataFrame:
    return on_channels(comments.where("template_id is not null"), videos).groupBy("channel_id").agg(F.count(F.lit(1)).alias("templated_comments"))


def commenters(comments: DataFrame, videos: DataFrame) -> DataFrame:
    return on_channels(comments, videos).select("channel_id", "account_id").distinct()


def burst(df: DataFrame, key: str, ms: str) -> DataFrame:
    """Rows of each key, and the most of them in any closed span of 24 hours.

    The window holds counts of equal instants, not rows: a popular key shrinks to its distinct instants.
    """
    instants = df.groupBy(key, ms).agg(F.count(F.lit(1)).alias("_n"))
    span = Window.partitionBy(key).orderBy(ms).rangeBetween(-DAY_MS, Window.currentRow)
    return instants.withColumn("_span", F.sum("_n").over(span)).groupBy(key).agg(F.sum("_n").alias("comment_count"), F.max("_span").alias("burst_comments"))


def velocity(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Bursts on each channel. Where comments were posted is stored before it is counted: a task never holds the join's rows and the counts at once."""
    return pace(stored(on_channels(comments, videos).select("channel_id", "posted_ms"), "posted"))


def pace(posts: DataFrame) -> DataFrame:
    """``velocity`` of (channel_id, posted_ms)."""
    counts = burst(posts, "channel_id", "posted_ms")
    return counts.withColumn("velocity", F.least(F.lit(1.0), F.col("burst_comments") / F.col("comment_count")))


def own_signals(channels: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints on the channel or on its owner, by type and value."""
    subjects = channels.select("channel_id", F.col("channel_id").alias("subject_id")).unionByName(channels.select("channel_id", F.col("account_id").alias("subject_id")))
    counted = hints.groupBy("subject_id", "signal_type", "signal_value").agg(F.count(F.lit(1)).alias("n"))
    return subjects.join(counted, "subject_id").groupBy("channel_id", "signal_type", "signal_value").agg(F.sum("n").alias("n"))


def shared_by(commenters_: DataFrame, hints: DataFrame) -> DataFrame:
    """Signal values that at least two of the distinct (channel_id, account_id) of a channel share."""
    held = hints.select(F.col("subject_id").alias("account_id"), "signal_type", "signal_value").distinct()
    return commenters_.join(held, "account_id").groupBy("channel_id", "signal_type", "signal_value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COORDINATION_FLOOR)


def _dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out by channel, in ``FINER`` times the session's shuffle partitions."""
    return df.repartition(FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "channel_id")


def coordinated(posts: DataFrame, hints: DataFrame) -> DataFrame:
    """``shared_by`` without the counts, of (channel_id, account_id) with repeats: two commenters differ if the least number among them is not the largest.

    Accounts are numbered in order of their ids within the partition of their hash, so a task that is run again gives the same numbers. Channels are dealt out
    before values are counted: a task counts those of its own channels alone, where counts before a deal would hold nearly all channels' values in every task.
    """
    value = F.struct("signal_type", "signal_value")
    held = hints.groupBy(F.col("subject_id").alias("account_id")).agg(F.collect_set(value).alias("values")).sortWithinPartitions("account_id").withColumn("_n", F.monotonically_increasing_id())
    dealt = _dealt(posts.select("channel_id", "account_id").join(held, "account_id").select("channel_id", "_n", "values"))
    each = dealt.select("channel_id", "_n", F.explode("values").alias("v")).select("channel_id", "_n", "v.*")
    return each.groupBy("channel_id", "signal_type", "signal_value").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b")).where("_a < _b").drop("_a", "_b")


def inbound_signals(comments: DataFrame, videos: DataFrame, hints: DataFrame) -> DataFrame:
    """Signal values that at least two distinct commenters of a channel share."""
    return shared_by(commenters(comments, videos), hints)


def _values(own: DataFrame, inbound: DataFrame) -> DataFrame:
    """Distinct values of each channel, dealt out by channel: what is then counted by channel stays in its task."""
    both = own.select("channel_id", "signal_type", "signal_value").unionByName(inbound.select("channel_id", "signal_type", "signal_value"))
    return _dealt(both).distinct()


def holder_bits(hints: DataFrame) -> DataFrame:
    """(signal_type, signal_value, bucket, bits): who holds each value, as bitmaps of 32,768 holders each.

    Holders are numbered in order of their ids within the partition of their hash, so a task that is run again gives the same numbers.
    """
    held = hints.select("signal_type", "signal_value", "subject_id").distinct()
    numbers = hints.select("subject_id").distinct().sortWithinPartitions("subject_id").withColumn("_n", F.monotonically_increasing_id())
    held = held.join(numbers, "subject_id").withColumn("bucket", F.bitmap_bucket_number("_n"))
    return held.groupBy("signal_type", "signal_value", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("bits"))


def holder_words(hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who holds each value, as (signal_type, signal_value, word, bits), and how many each bit stands for, as (word, least, most, holders).

    A bit is not a holder but all holders of the same values: there are far fewer of these, and they are few however many holders there are. They are numbered
    in order of their counts within a partition, so nearly all bits of a word stand for equally many, and a task that is run again gives the same numbers.
    """
    held = hints.select("subject_id", F.struct("signal_type", "signal_value").alias("v")).distinct()
    alike = held.groupBy("subject_id").agg(F.sort_array(F.collect_list("v")).alias("values")).withColumn("id", F.sha2(F.to_json("values"), 256))
    kinds = alike.groupBy("id").agg(F.first("values").alias("values"), F.count(F.lit(1)).alias("n")).sortWithinPartitions("n", "id").withColumn("_n", F.monotonically_increasing_id())
    kinds = kinds.select("values", "n", F.floor(F.col("_n") / 64).alias("word"), (F.col("_n") % 64).cast("int").alias("bit"))
    kinds = stored(kinds, "kinds")
    bits = kinds.select(F.explode("values").alias("v"), "word", F.expr("shiftleft(1L, bit)").alias("bits")).groupBy("v", "word").agg(F.bit_or("bits").alias("bits")).select("v.*", "word", "bits")
    return bits, kinds.groupBy("word").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.map_from_entries(F.collect_list(F.struct("bit", "n"))).alias("holders"))


def spread(channels: DataFrame, own: DataFrame, inbound: DataFrame, hints: DataFrame) -> DataFrame:
    """Distinct other holders of any of the channel's values, as a share of the cap.

    The holders of a value are a few words of bits, however many they are; those of a set of values are the words' union, counted once for each distinct
    set. A channel then subtracts itself and its owner, if they are among them.
    """
    values = _values(own, inbound)
    sets = values.groupBy("channel_id").agg(F.sort_array(F.collect_list(F.struct("signal_type", "signal_value"))).alias("values"))
    sets = sets.withColumn("set_id", F.sha2(F.to_json("values"), 256))
    each = sets.groupBy("set_id").agg(F.first("values").alias("values")).select("set_id", F.explode("values").alias("v")).select("set_id", "v.*")
    words, weights = holder_words(hints)
    union = each.join(words, ["signal_type", "signal_value"]).groupBy("set_id", "word").agg(F.bit_or("bits").alias("bits"))
    one_by_one = F.expr("aggregate(map_entries(holders), 0L, (a, x) -> a + if(getbit(bits, x.key) = 1, x.value, 0L))")
    count = F.when(F.col("least") == F.col("most"), F.bit_count("bits") * F.col("least")).otherwise(one_by_one)
    total = union.join(weights, "word").groupBy("set_id").agg(F.sum(count).alias("all"))
    selves = channels.select("channel_id", F.explode(F.array_distinct(F.array("channel_id", "account_id"))).alias("subject_id"))
    mine = selves.join(hints.select("signal_type", "signal_value", "subject_id"), "subject_id").join(values, ["channel_id", "signal_type", "signal_value"]).groupBy("channel_id").agg(F.count_distinct("subject_id").alias("mine"))
    peers = sets.select("channel_id", "set_id").join(total, "set_id").join(channels.select("channel_id"), "channel_id").join(mine, "channel_id", "left")
    peers = peers.select("channel_id", (F.col("all") - F.coalesce("mine", F.lit(0))).alias("peer_entities")).where("peer_entities > 0")
    return peers.withColumn("spread", F.least(F.lit(1.0), F.col("peer_entities") / SPREAD_CAP))


def recidivism(own: DataFrame, inbound: DataFrame, hints: DataFrame) -> DataFrame:
    """Distinct days (in +05:30) on which any of the channel's values was seen anywhere."""
    day = F.floor((F.col("observed_ms") + IST_MS) / DAY_MS)
    days = stored(hints.select("signal_type", "signal_value", day.alias("day")).distinct(), "days")
    out = _values(own, inbound).join(days, ["signal_type", "signal_value"]).groupBy("channel_id").agg(F.count_distinct("day").alias("pattern_days"))
    return out.withColumn("recidivism", F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("pattern_days") - 1) / RECIDIVISM_CAP))


class Signals:
    """What several components share, worked out once and stored: who comments where and when, own and inbound signal values."""

    def __init__(self, channels: DataFrame, videos: DataFrame, comments: DataFrame, hints: DataFrame):
        self.channels, self.videos, self.comments, self.hints = channels, videos, comments, hints
        posts = on_channels(comments, videos).select("channel_id", "account_id", "posted_ms", F.col("template_id").isNotNull().alias("templated"))
        self.posts = stored(posts, "posts")
        self.own = stored(own_signals(channels, hints), "own")
        self.inbound = stored(coordinated(self.posts, hints), "inbound")

    def severe(self) -> DataFrame:
        """Every channel with a signal of its own, coordinated commenters or templates, and its severity."""
        kinds = lambda df, name: df.groupBy("channel_id").agg(F.array_sort(F.collect_set("signal_type")).alias(name))
        copies = self.posts.where("templated").groupBy("channel_id").agg(F.count(F.lit(1)).alias("templated_comments"))
        df = self.channels.select("channel_id", "account_id")
        for part in (kinds(self.own, "own_kinds"), kinds(self.inbound, "inbound_kinds"), undisclosed(self.videos), copies):
            df = df.join(part, "channel_id", "left")
        none = F.array().cast("array<string>")
        df = df.fillna({"undisclosed_videos": 0, "templated_comments": 0}).withColumn("kinds", F.array_union(F.coalesce("own_kinds", none), F.coalesce("inbound_kinds", none)))
        df = df.where((F.size("kinds") > 0) | (F.col("templated_comments") > 0))
        parts = [F.when(F.array_contains("kinds", k), F.lit(w)).otherwise(F.lit(0.0)) for k, w in SEVERITY.items()]
        parts += [F.when(F.col("undisclosed_videos") > 0, UNDISCLOSED).otherwise(0.0), F.when(F.col("templated_comments") > 0, TEMPLATED).otherwise(0.0)]
        return df.select("channel_id", "account_id", F.greatest(*parts).alias("severity_class"), "undisclosed_videos", "templated_comments")

    def scored(self, df: DataFrame, few: DataFrame | None = None) -> DataFrame:
        """The rows of ``severe`` with the other components, worked out for the channels of ``few`` alone (or for all)."""
        only = (lambda x: x.join(few, "channel_id", "left_semi")) if few is not None else (lambda x: x)
        channels, own, inbound = only(self.channels), only(self.own), only(self.inbound)
        for part in (pace(only(self.posts)), spread(channels, own, inbound, self.hints), recidivism(own, inbound, self.hints)):
            df = df.join(part, "channel_id", "left")
        zero = {c: 0 for c in ("undisclosed_videos", "templated_comments", "comment_count", "burst_comments", "peer_entities", "pattern_days")}
        return df.fillna(zero | {c: 0.0 for c in ("velocity", "spread", "recidivism")}).select("channel_id", "account_id", *WEIGHTS, *zero)


def flagged(channels: DataFrame, videos: DataFrame, comments: DataFrame, hints: DataFrame) -> DataFrame:
    """Every flagged channel and its components."""
    signals = Signals(channels, videos, comments, hints)
    return signals.scored(signals.severe())


def clamped(limit: object) -> int:
    """A queue's limit: what was asked for within 1 and the ceiling, the ceiling where that is no positive whole number."""
    return min(limit, QUEUE) if isinstance(limit, int) and not isinstance(limit, bool) and limit > 0 else QUEUE


def cases(channels: DataFrame, videos: DataFrame, comments: DataFrame, hints: DataFrame, limit: int = QUEUE) -> DataFrame:
    """``queue`` of all flagged channels: the cut needs severity only, so the rest is worked out for the cases alone."""
    signals = Signals(channels, videos, comments, hints)
    top = stored(signals.severe().orderBy(F.desc("severity_class"), "channel_id").limit(clamped(limit)), "cases")
    few = F.broadcast(top.select("channel_id"))  # at most `limit` rows
    return queue(signals.scored(top, few), limit)


def queue(found: DataFrame, limit: int = QUEUE) -> DataFrame:
    """The most severe channels, numbered in that order."""
    top = found.orderBy(F.desc("severity_class"), "channel_id").limit(clamped(limit))
    order = Window.orderBy(F.desc("severity_class"), "channel_id")  # at most `limit` rows
    return top.withColumn("case_id", F.format_string("case-%04d", F.row_number().over(order) - 1))


def ranked(cases: DataFrame) -> DataFrame:
    """The queue by priority; cut by severity before, on purpose."""
    total = sum((F.col(c) * w for c, w in list(WEIGHTS.items())[1:]), F.col("severity_class") * WEIGHTS["severity_class"])
    order = Window.orderBy(F.desc("priority"), "case_id")  # at most `limit` rows
    return cases.withColumn("priority", total).withColumn("rank", F.row_number().over(order))


def discriminating(rows: DataFrame) -> DataFrame:
    """The component that most separates each case from the cases ranked next to it.

    If the neighbours agree, the component that varies most over the queue; if none does, the largest weighted.
    """
    by, all_ = Window.orderBy("rank"), Window.partitionBy(F.lit(1))  # at most `limit` rows
    apart, wide, big = [], [], []
    for name, w in WEIGHTS.items():
        x, before, after = F.col(name), F.lag(name).over(by), F.lead(name).over(by)
        mean = F.when(before.isNull(), after).when(after.isNull(), before).otherwise((before + after) / 2)
        apart.append(F.coalesce(F.abs(x - mean) * w, F.lit(0.0)))
        wide.append((F.max(x).over(all_) - F.min(x).over(all_)) * w)
        big.append(x * w)
    names = F.array(*map(F.lit, WEIGHTS))
    first = lambda values: F.element_at(names, F.array_position(F.array(*values), F.greatest(*values)).cast("int"))
    choice = F.when(F.greatest(*apart) > 0, first(apart)).when(F.greatest(*wide) > 0, first(wide)).otherwise(first(big))
    return rows.select("case_id", "channel_id", "rank", choice.alias("component"))


def case_records(cases: DataFrame, channels: DataFrame, comments: DataFrame, videos: DataFrame, first: int = 3) -> DataFrame:
    """What a reviewer reads of each case: name, description, the first comments by id."""
    few = F.broadcast(cases.select("case_id", "channel_id"))  # at most `limit` rows
    about = channels.join(few, "channel_id")
    name = about.select("case_id", F.concat(F.lit("channel:"), "channel_id", F.lit(":name")).alias("record_id"), F.lit("display_name").alias("source"), F.col("display_name").alias("text"))
    note = about.select("case_id", F.concat(F.lit("channel:"), "channel_id", F.lit(":description")).alias("record_id"), F.lit("description").alias("source"), F.col("description").alias("text"))
    own = comments.join(videos.select("video_id", "channel_id").join(few, "channel_id"), "video_id")
    turn = Window.partitionBy("case_id").orderBy("comment_id")
    said = own.withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= first).select("case_id", F.concat(F.lit("comment:"), "comment_id").alias("record_id"), F.lit("comment").alias("source"), "text")
    return name.unionByName(note).unionByName(said)
