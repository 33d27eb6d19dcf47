"""Hash-chained ledger: entry hashes, chain verification, heads, event counts, activation log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DOMAIN, GENESIS, SEPARATOR = "ringwatch.ledger.v1", "0" * 64, "\x1f"
#: The events a ledger may hold.
EVENTS = (
    "prompt_sent", "tool_called", "tool_result", "output_proposed", "verification_pass", "verification_fail", "gate_rejection",
    "human_decision", "mandate_violation_attempt", "session_open", "session_close",
)
FIELDS = ("seq", "timestamp_ist", "agent_id", "mandate_hash", "event_type", "payload_digest", "prev_hash")


def digest(*fields: Column) -> Column:
    """SHA-256 over fields joined by the unit separator; a null field is the empty one."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def entry_hash(prev: Column | None = None) -> Column:
    columns = [F.col(c) for c in FIELDS[:-1]]
    return digest(F.lit(DOMAIN), *columns, F.col("prev_hash") if prev is None else prev)


#: Entries of a session that are checked in one window: a range of seq.
SPAN = 65_536


def chained(entries: DataFrame, session: str) -> DataFrame:
    """Entries with prev_hash and entry_hash, hashed in one pass over each session in order of seq.

    A chain is sequential by nature: an entry's hash needs the one before. The pass keeps one hash, whatever a session's length; sessions are
    independent and run in parallel.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS[1:-1]]
    rows = entries.select(F.col(session), F.col("seq").cast("long").alias("seq"), *texts)
    ordered = rows.repartition(session).sortWithinPartitions(session, "seq", *FIELDS[1:-1])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tail = object(), GENESIS
        for batch in batches:
            prev, own = [], []
            for key, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, tail = key, GENESIS
                prev.append(tail)
                tail = hashlib.sha256(SEPARATOR.join([DOMAIN, str(cells[0]), *cells[1:], tail]).encode()).hexdigest()
                own.append(tail)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prev, pa.string()), pa.array(own, pa.string())], names=[*batch.schema.names, "prev_hash", "entry_hash"])

    kind = rows.schema[session].dataType.simpleString()
    return ordered.mapInArrow(link, f"`{session}` {kind}, seq long, {', '.join(f'{c} string' for c in FIELDS[1:-1])}, prev_hash string, entry_hash string")


def in_order(entries: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """``entries`` with ``position`` (from 0, in order of seq within the keys) and ``before``, the carried columns of the entry before.

    Ranges of seq are ordered by themselves; a range begins where those before it end, which one row a range tells. No window holds a whole session.
    """
    cell = F.struct(*carried)
    marked = entries.withColumn("_part", F.floor(F.col("seq") / SPAN)).repartition(*keys, "_part")  # else rows already dealt by session would stay so
    ends = marked.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.max_by(cell, F.struct("seq", *carried)).alias("_last"))
    parts = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")  # one row a range
    bases = ends.select(*keys, "_part", F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lag("_last").over(parts).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy("seq", *carried)
    rows = marked.join(bases, [*keys, "_part"]).withColumn("position", (F.col("_base") + F.row_number().over(inside) - 1).cast("long"))
    return rows.withColumn("before", F.coalesce(F.lag(cell).over(inside), F.col("_before"))).drop("_part", "_base", "_before")


def verified(entries: DataFrame, session: str) -> DataFrame:
    """First break of each session's chain: position, reason, and the seq that was expected there.

    A row is checked against its stored predecessor only, so ranges of a session are checked in parallel and no
    chain is folded again. Cutting off the end leaves a valid chain; compare :func:`heads` for that.
    """
    df = in_order(entries, [session], ["entry_hash"])
    reason = (
        F.when(F.col("seq") != F.col("position"), "seq_gap")
        .when((F.col("position") == 0) & (F.col("prev_hash") != GENESIS), "genesis_mismatch")
        .when((F.col("position") > 0) & (F.col("prev_hash") != F.col("before.entry_hash")), "prev_hash_mismatch")
        .when(F.col("entry_hash") != entry_hash(), "entry_hash_mismatch")
    )
    marked = df.withColumn("reason", reason)
    return marked.groupBy(session).agg(
        F.count(F.lit(1)).alias("entries"), F.min(F.when(F.col("reason").isNotNull(), F.col("position"))).alias("first_break"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("position"))).alias("reason"),
    ).withColumn("ok", F.col("first_break").isNull())


def anchored(entries: DataFrame, anchors: DataFrame, session: str) -> DataFrame:
    """Each anchored session's outcome: ``broken_chain`` before ``head_mismatch`` before ``intact``; anchors have the session and its expected ``head``.

    A session of which nothing is left has the empty head and does not match.
    """
    found = verified(entries, session).join(heads(entries, session), session)
    both = anchors.select(session, F.col("head").alias("expected")).join(found, session, "left")
    outcome = F.when(F.col("first_break").isNotNull(), "broken_chain").when(F.col("head").eqNullSafe(F.col("expected")), "intact").otherwise("head_mismatch")
    return both.select(session, F.coalesce("entries", F.lit(0)).alias("entries"), outcome.alias("outcome"), "reason")


def heads(entries: DataFrame, session: str) -> DataFrame:
    """COUNT:HASH of each session, which also betrays a cut-off end."""
    return entries.groupBy(session).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.max_by("entry_hash", "seq")).alias("head"))


def event_counts(entries: DataFrame) -> DataFrame:
    """How often each known event occurs, zeros included."""
    names = entries.sparkSession.createDataFrame([(e,) for e in EVENTS], "event_type string")
    return names.join(entries.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type", "left").fillna(0, ["n"])


def pass_rate(entries: DataFrame) -> DataFrame:
    good, bad = F.count_if(F.col("event_type") == "verification_pass"), F.count_if(F.col("event_type") == "verification_fail")
    return entries.agg(good.alias("passed"), bad.alias("failed")).withColumn("rate", F.when(F.col("passed") + F.col("failed") > 0, F.col("passed") / (F.col("passed") + F.col("failed"))))


def current(activations: DataFrame) -> DataFrame:
    """The digest each task runs now: that of its last activation."""
    return activations.groupBy("task").agg(F.max_by("content_digest", "seq").alias("content_digest"), F.max("seq").alias("seq"))


def bad_rollbacks(activations: DataFrame) -> DataFrame:
    """Rollbacks to a digest that never ran before in the task."""
    ran = activations.groupBy("task", "content_digest").agg(F.min("seq").alias("first"))
    return activations.where("action = 'rollback'").join(ran, ["task", "content_digest"]).where("first >= seq").select("task", "seq", "content_digest")


def log_faults(activations: DataFrame, log: str) -> DataFrame:
    """What is wrong with each entry of an append-only activation log, the first of: a gap in seq, a time before the entry before, a rollback to what never ran."""
    ran = activations.groupBy(log, "task", "content_digest").agg(F.min("seq").alias("_first"))
    df = in_order(activations, [log], ["timestamp_ist"]).join(ran, [log, "task", "content_digest"])
    code = (
        F.when(F.col("seq") != F.col("position"), "seq_gap").when(F.col("timestamp_ist") < F.col("before.timestamp_ist"), "moves_back_in_time")
        .when((F.col("action") == "rollback") & (F.col("_first") >= F.col("seq")), "rollback_to_unknown")
    )
    return df.select(log, "seq", code.alias("code")).where("code is not null")


class Writer:
    """Appends entries to one chain on the driver, keeping the tail in memory."""

    def __init__(self, seq: int = 0, tail: str = GENESIS):
        self.seq, self.tail = seq, tail

    def append(self, timestamp_ist: str, agent_id: str | None, mandate_hash: str, event_type: str, payload_digest: str) -> dict:
        if event_type not in EVENTS:
            raise ValueError(f"unknown event {event_type}")
        row = dict(zip(FIELDS, (self.seq, timestamp_ist, agent_id, mandate_hash, event_type, payload_digest, self.tail), strict=True))
        row["entry_hash"] = canonical([DOMAIN, str(self.seq), timestamp_ist, agent_id or "", mandate_hash, event_type, payload_digest, self.tail])
        self.seq, self.tail = self.seq + 1, row["entry_hash"]
        return row


def canonical(fields: Iterable[str]) -> str:
    """The driver's form of :func:`digest`; a field that holds the separator is refused."""
    fields = list(fields)
    if any(SEPARATOR in f for f in fields):
        raise ValueError("a field holds the separator")
    return hashlib.sha256(SEPARATOR.join(fields).encode()).hexdigest()
