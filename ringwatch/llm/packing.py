"""Hierarchical packing of token sequences into windows of several sizes.

Each document's ids are cut at multiples of the largest window. Whole windows stand alone; the
rest of each document is routed to the tier whose window is the smallest that holds it (an eighth, a quarter,
a half and the whole of the largest). The longest tier is packed first: each of its rests leads a long window, whose gap
is filled best-fit from the shorter tiers. Then each shorter tier, from long to short, packs what is left of it
into windows of its own size, if they come out exactly full (a shorter window that isn't would be padded to the largest). Rests that find
no such company share long windows. The plan needs nothing but how many rests there are of each length (at most ``window``
numbers whatever the corpus), so it is made once, as groups of equal windows; documents then find
their place by their rank among rests of the same length, with hash-bucketed ranks.

Sequences are numbered from the fullest to the emptiest and dealt to step groups in snake order, so
that the tokens of any two groups differ by one window at most.

Nulls: a null text is empty and has the end id only; a null doc_id is kept. Repeated rows are separate documents and get
places of their own. Very long texts are cut as any other; a task holds a few megabytes of text, or one text. Ties in a rank (rows alike in
doc_id, start and checksum) are alike in every column of the result. An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import only, ranked, salt, saved, small_batches
from ringwatch.llm.words import merged

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of every document: whole windows, and the rest as one piece."""
    small_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ringwatch.llm.bpe import Encoder

        encoder = Encoder(tokenizer)
        for batch in merged(batches, "text"):
            ids, counts = encoder.encode(batch.column("text"))
            doc, n_all = batch.column("doc_id").cast(pa.int64()), counts + 1
            wide = np.full(int(n_all.sum()), end_id, "<u4")
            begin = np.cumsum(n_all) - n_all
            keep = np.ones(len(wide), bool)
            keep[begin + counts] = False
            wide[keep] = ids
            blob = memoryview(wide).cast("B")
            n_pieces = -(-n_all // window)
            index = np.repeat(np.arange(len(doc)), n_pieces)
            start = (np.arange(len(index)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * window
            length = np.minimum(window, n_all[index] - start)
            at = (begin[index] + start).tolist()
            crc = [zlib.crc32(blob[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    doc.take(pa.array(index)),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()),
                    pa.array(crc, pa.int64()),
                    pa.array(n_all[index], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return only(docs, "doc_id", "text").mapInArrow(pieces, PIECES)


def tiers(window: int) -> list[int]:
    """Window sizes, ascending."""
    return [w for w in (window >> 3, window >> 2, window >> 1) if w] + [window]


def plan(counts: dict[int, int], window: int = 1024) -> list[tuple[int, int, list[int]]]:
    """Groups ``(window, how many, lengths in each)`` that use up ``counts`` rests of each length.

    One round handles as many equal windows as the scarcest length in them allows, so there are a few rounds
    per length, not per document.
    """
    left = {k: v for k, v in counts.items() if v}
    groups: list[tuple[int, int, list[int]]] = []

    def filled(size: int, lead: int) -> tuple[int, dict[int, int]]:
        """Room left in a window after its lead, then ever the longest rest that fits."""
        used, room = {lead: 1}, size - lead
        for k in sorted(left, reverse=True):
            if k <= room and (fit := min(room // k, left[k] - used.get(k, 0))):
                used[k] = used.get(k, 0) + fit
                room -= k * fit
        return room, used

    def take(size: int, used: dict[int, int]) -> None:
        times = min(left[k] // n for k, n in used.items())
        groups.append((size, times, [k for k, n in used.items() for _ in range(n)]))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]

    *shorter, whole = tiers(window)
    while long := [k for k in left if k > whole // 2]:
        take(whole, filled(whole, max(long))[1])
    for size in reversed(shorter):
        for lead in range(size, size // 2, -1):
            while lead in left:
                room, used = filled(size, lead)
                if room:
                    break
                take(size, used)
    while left:
        take(whole, filled(whole, max(left))[1])
    return groups


def snake(position: Column, groups: int) -> Column:
    """Group of a position when positions are dealt to groups there and back again."""
    turn, nth = F.floor(position / groups), F.pmod(position, F.lit(groups).cast("long"))
    return F.when(F.pmod(turn, F.lit(2).cast("long")) == 0, nth).otherwise(groups - 1 - nth).cast("long")


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, step: int = 64) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Extra columns: ``tier`` (the window the piece was routed to), ``window`` (that of its sequence), ``sequence_length``
    (what the sequence holds) and ``step_group`` (of at most ``step`` sequences).
    """
    pieces = saved(cut(docs, tokenizer, window, end_id), "pieces")
    whole, rests = pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)
    rows = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_whole = whole.count()
    spark = docs.sparkSession
    buckets = min(8192, max(64, (n_whole + sum(rows.values())) // 5_000))
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    bucket = salt([F.col("doc_id"), F.col("start")], buckets)

    places, first = [], n_whole
    taken = dict.fromkeys(rows, 0)
    for size, times, lengths in sorted(plan(rows, window), key=lambda g: -sum(g[2])):
        offset = 0
        for k in dict.fromkeys(lengths):
            each = lengths.count(k)
            places.append((k, taken[k], taken[k] + times * each, first, each, offset, sum(lengths), size))
            taken[k] += times * each
            offset += k * each
        first += times
    groups = max(1, -(-first // step))
    schema = "length int, low long, high long, first long, each int, base int, sequence_length int, window int"
    # At most a few rows per length of the window: bounded by the window, not by the corpus.
    slots = F.broadcast(spark.createDataFrame(places, schema))
    numbered = ranked(rests, ["length"], order, bucket)
    inside = (numbered["rank"] >= slots["low"]) & (numbered["rank"] < slots["high"])
    nth = F.col("rank") - F.col("low")
    put = numbered.join(slots, (numbered["length"] == slots["length"]) & inside).select(
        *[numbered[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")],
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(nth, F.col("each").cast("long")) * numbered["length"]).cast("long").alias("offset"),
        "sequence_length",
        "window",
    )
    size = F.lit(window)
    alone = ranked(whole, [], order, bucket, "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), size.alias("sequence_length"), size.alias("window")
    )
    tier = F.lit(window)
    for w in reversed(tiers(window)[:-1]):
        tier = F.when(F.col("length") <= w, w).otherwise(tier)
    return alone.unionByName(put).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset",
        tier.cast("int").alias("tier"), "window", "sequence_length", snake(F.col("sequence_id"), groups).alias("step_group"),
    )
