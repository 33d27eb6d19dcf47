"""Balanced label propagation: shards of equal row counts that keep linked documents together.

Documents of a group (by default: equal texts) are linked. Documents start in shards by a hash of their id, which knows
nothing of groups. A group's members are alike, so the
state is how many members of a group each shard holds (at most ``shards`` rows a group) and how
many unlinked documents each shard holds (``shards`` numbers). In each round the parts of a group tell the group their
sizes, and a join tells every part what its neighbours' largest shard with room is; a part wants to
move there. Quotas are the largest flows found between shards that
bring no shard more than leaves it plus its unlinked documents, which give way in exchange. So every shard keeps its
row count in every round, and row counts differ by one at most (law ``rows``). A document only ever moves to a part at least as large as
its own, so linked pairs within shards grow with every move, and rounds end when nothing moves: where no unlinked documents
can give way, that is once the wishes form no more closed exchanges.
A group larger than its shard's room settles in as few shards as the quotas allow. ``cut_edges`` counts linked pairs in different shards.

Nulls: a null text is the empty text (16 bytes of size, checksum 0); a null doc_id is a value like others. Repeated rows are documents of
their own. Very long texts count by rows like any other. Ties (rows alike in doc_id and checksum) get neighbouring slots, in either order. An empty
table gives no rows. With fewer documents than shards some shards stay empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.llm.common import only, ranked, salt, saved

#: Bytes a document takes besides its text.
OVERHEAD = 16


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, checksum and group of each document."""
    text = F.coalesce("text", F.lit(""))
    return only(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("group")
    )


def _start(linked: DataFrame, shards: int, spread: int) -> DataFrame:
    """(group, shard, n): documents dealt evenly in order of a hash of their ids, whatever their group."""
    dealt = ranked(linked.select("doc_id", "group", "text_crc32"), [], [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_crc32")], salt([F.col("doc_id")], spread))
    return dealt.groupBy("group", F.pmod("rank", F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def cut_edges(parts: DataFrame) -> int:
    """How many pairs of linked documents lie in different shards."""
    each = parts.groupBy("group").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("kept"))
    return int(each.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("kept")) / 2), F.lit(0.0))).first()[0])


def circulation(want: dict[tuple[int, int], int], free: dict[int, int]) -> dict[tuple[int, int], int]:
    """The largest share found of each wish (s, t) that lets every shard take no more than leaves it or is free there.

    Flows into shards that would overflow are scaled down until none does; what one shard then doesn't
    send is missing in another, so this is repeated. Whole numbers at the end.
    """
    flow: dict[tuple[int, int], float] = {k: float(w) for k, w in want.items() if w}

    def excess() -> tuple[dict[int, float], dict[int, float]]:
        into, out = dict.fromkeys(free, 0.0), dict.fromkeys(free, 0.0)
        for (s, t), x in flow.items():
            out[s] += x
            into[t] += x
        return into, {t: out[t] + free[t] for t in free}

    for _ in range(200):
        into, most = excess()
        if all(into[t] <= most[t] + 1e-6 for t in free):
            break
        flow = {(s, t): x * min(1.0, most[t] / into[t]) for (s, t), x in flow.items() if into[t]}
    flow = {k: int(x + 1e-6) for k, x in flow.items()}
    while True:
        into, most = excess()
        over = {t: into[t] - most[t] for t in free if into[t] > most[t]}
        if not over:
            break
        for t, less in over.items():
            for k in sorted((k for k in flow if k[1] == t), key=lambda k: -flow[k]):
                cut = min(less, flow[k])
                flow[k] -= cut
                less -= cut
    used, room, grown = {k: int(flow.get(k, 0)) for k in want}, dict(free), True
    for (s, t), x in used.items():
        room[s] += x
        room[t] -= x
    while grown:
        grown = False
        for s, t in sorted(want, key=lambda k: (-want[k], k)):
            if more := min(want[s, t] - used[s, t], room[t]):
                used[s, t] += more
                room[s] += more
                room[t] -= more
                grown = True
    return used


def _round(parts: DataFrame, pool: dict[int, int]) -> tuple[DataFrame, int, dict[int, int]]:
    """One round: the parts after it, how many documents moved, and the unlinked of each shard."""
    spark = parts.sparkSession
    room = F.broadcast(spark.createDataFrame(sorted(pool.items()), "shard int, free long"))  # one row a shard
    sized = parts.join(room, "shard").withColumn("_me", F.struct(F.col("n"), F.xxhash64("group", "shard").alias("h"), F.col("shard").alias("to")))
    heard = sized.groupBy("group").agg(F.coalesce(F.max(F.when(F.col("free") > 0, F.col("_me"))), F.max("_me")).alias("_best"))
    aim = sized.join(heard, "group")
    wish = F.when(F.col("_me") < F.col("_best"), F.col("_best.to"))
    aim = saved(aim.select("group", "shard", "n", wish.alias("to"), F.col("_best.n").alias("gain")), "aims")
    want = {(r["shard"], r["to"]): r["w"] for r in aim.where("to is not null").groupBy("shard", "to").agg(F.sum("n").alias("w")).collect()}
    quota = circulation(want, pool)
    moved = sum(quota.values())
    if not moved:
        return parts, 0, pool
    pool = dict(pool)
    for (s, t), q in quota.items():
        pool[s] += q
        pool[t] -= q
    limits = F.broadcast(spark.createDataFrame([(s, t, q) for (s, t), q in quota.items()], "shard int, to int, quota long"))  # shards squared
    # Largest gains first; what goes before a part is summed within buckets and over the buckets before.
    going = aim.where("to is not null").join(limits, ["shard", "to"])
    going = going.withColumn("_b", (63 - F.floor(F.log2("gain"))).cast("int") * 64 + salt([F.col("group")], 64))
    sums = going.groupBy("shard", "to", "_b").agg(F.sum("n").alias("_all"))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "to", "_b", F.coalesce(F.sum("_all").over(upto("shard", "to").orderBy("_b")), F.lit(0)).alias("_before"))
    going = going.withColumn("_in", F.coalesce(F.sum("n").over(upto("shard", "to", "_b").orderBy(F.desc("gain"), "group")), F.lit(0)))
    going = going.join(sums, ["shard", "to", "_b"]).withColumn("_sum", F.col("_in") + F.col("_before"))
    going = going.withColumn("go", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("_sum"))))
    split = F.explode(F.array(F.struct("shard", (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("go").alias("n"))))
    new = aim.where("to is null").select("group", "shard", "n").unionByName(going.select("group", split.alias("x")).select("group", "x.shard", "x.n"))
    return saved(new.where("n > 0").groupBy("group", "shard").agg(F.sum("n").alias("n")), "parts"), moved, pool


def propagate(parts: DataFrame, pool: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Parts (group, shard, n) after the rounds, and the unlinked of each shard."""
    moved = 1
    while moved:
        parts, moved, pool = _round(parts, pool)
    return parts, pool


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard and slot of every document under law ``rows``."""
    rows = saved(described(docs), "described")
    total = rows.count()
    spread = min(8192, max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 5000))
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sizes = saved(sizes, "groups")
    linked = sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    # Groups with a thousandth of the rows or more (so at most a thousand) are dealt to buckets.
    hot = max(200, total // 1000)
    big = F.broadcast(sizes.where(F.col("members") >= hot).select("group", F.col("members").alias("_hot")))
    small = sizes.where(F.col("members") < hot).select("group", F.col("members").alias("_few"))
    marked = saved(rows.join(big, "group", "left"), "marked")
    calm = saved(marked.where("_hot is null").drop("_hot").join(small, "group", "left"), "calm")
    order = [F.col("doc_id"), F.col("text_crc32")]
    every = marked.where("_hot is not null").select("doc_id", "group", "text_crc32").unionByName(calm.where("_few is not null").select("doc_id", "group", "text_crc32"))
    share = lambda n, i: n // shards + (i < n % shards)
    parts = saved(_start(every, shards, spread), "parts")
    parts, pool = propagate(parts, {i: share(total, i) - share(linked, i) for i in range(shards)})
    of_big = ranked(marked.where("_hot is not null").drop("_hot"), ["group"], order, salt([F.col("doc_id")], spread))
    of_small = calm.where("_few is not null").drop("_few").withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order)).cast("long") - 1)
    upto = Window.partitionBy("group").orderBy("shard")
    ends = parts.withColumn("end", F.sum("n").over(upto)).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"))  # at most `shards` a group
    place = lambda ends, rank: F.get(F.filter(ends, lambda e: e["end"] > rank), F.lit(0))["shard"]
    big_ends = F.broadcast(ends.join(big, "group").drop("_hot"))
    in_groups = of_small.join(ends, "group").unionByName(of_big.join(big_ends, "group"))
    put = in_groups.select("doc_id", "size", "text_crc32", place(F.col("ends"), F.col("rank")).alias("shard"))

    steps, at = [], 0
    for s in range(shards):
        steps.append((at, at + pool[s], s))
        at += pool[s]
    bounds = F.array(*[F.lit(b) for _, b, _ in steps])
    free = ranked(calm.where("_few is null").drop("_few"), [], order, salt([F.col("doc_id")], spread))
    alone = free.select("doc_id", "size", "text_crc32", F.size(F.filter(bounds, lambda b: b <= F.col("rank"))).alias("shard"))
    placed = saved(put.unionByName(alone.select("doc_id", "size", "text_crc32", "shard")), "placed")
    slots = ranked(placed, ["shard"], order, salt([F.col("doc_id"), F.col("text_crc32")], max(8, spread // 8)), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
