"""Importance resampling of documents towards a target corpus, over hashed runs of words.

A feature is a run of ``low`` to ``high`` consecutive words (letters and digits, A-Z lower-cased), joined by a space; its bucket is
the checksum of its bytes modulo ``buckets``. A block of texts becomes one sequence of word ids. Its suffix array (places in order
of the words that follow, as far as ``high`` words, by doubling) brings equal runs of words side by side; where neighbours share at
least n words (their LCP), they are one n-gram, so each distinct n-gram of a block is hashed once and its bucket is scattered back
to all its places. No run crosses the end of a text.

The buckets of a document's features are stored once (two bytes each) and read twice: to count every bucket over the corpus, and, once the
gains of the buckets are known, to weigh the document. Only the counts of the buckets, a bounded number, reach the driver. A
document's score is its weight and a Gumbel draw that depends on its doc_id alone; the highest scores are a sample without
replacement in proportion to the weights. Ranks come from a range partitioning by score and the sizes of its parts.

Nulls: a null text has no words; a null doc_id draws as the empty string and sorts after all others among equal scores. Repeated rows are documents of
their own; rows alike in score and doc_id are alike in the result but for their ranks. Empty texts, and texts with fewer words than ``least``,
are weighed but never drawn. A very long text is one block. An empty table gives no rows; without a target all its counts are 0. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.llm.common import only, saved, small_batches
from ringwatch.llm.words import MARK, merged, split_words

#: Bytes of text in a block.
BLOCK = 6 << 20


def suffixes(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the next ``depth`` words, and how many words each shares with the place before it in that order (at most ``depth``).

    ``left`` is the number of words from each place to the end of its text.
    """
    n, known = len(ids), 1
    rank = ids.astype(np.int64) + 1
    while known < depth:
        later = np.zeros(n, np.int64)
        later[: max(n - known, 0)] = rank[known:]
        later[left <= known] = 0
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + later, return_inverse=True)[1] + 1
        known *= 2
    order = np.argsort(rank, kind="stable")
    shared, same = np.zeros(n, np.int32), np.ones(max(n - 1, 0), bool)
    for d in range(depth):
        at = np.flatnonzero(same)
        a, b = order[at], order[at + 1]
        long = (left[a] > d) & (left[b] > d)
        at, a, b = at[long], a[long], b[long]
        same[:] = False
        same[at[ids[a + d] == ids[b + d]]] = True
        shared[1:] += same
    return order, shared


def features(texts: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, features of each text, and the buckets of all features, text by text."""
    ids, words, counts = split_words(texts, between=MARK)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(ids))
    order, shared = suffixes(ids, left, high)
    names = words.to_pylist()
    found, owner = [], []
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    for n in range(low, high + 1):
        head = shared < n
        first = order[head]
        fits = left[first] >= n
        run = np.full(len(first), -1, np.int64)  # the bucket of each run, hashed once
        runs = (ids[first[fits, None] + np.arange(n)]).tolist()
        run[fits] = np.fromiter((zlib.crc32(b" ".join([names[w] for w in r])) % buckets for r in runs), np.int64, len(runs))
        bucket = np.empty(len(ids), np.int64)
        bucket[order] = run[np.cumsum(head) - 1]
        at = np.flatnonzero(bucket >= 0)
        found.append(bucket[at])
        owner.append(text[at])
    found, owner = np.concatenate(found), np.concatenate(owner)
    if high > low:
        found = found[np.argsort(owner, kind="stable")]
    return counts, np.bincount(owner, minlength=len(counts)), found


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(df: DataFrame, low: int, high: int, buckets: int, keep: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of every row; ``keep`` names the id column (none: null)."""
    kind = _kind(buckets)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", BLOCK):
            words, n, found = features(batch.column("text"), low, high, buckets)
            found, ends = found.astype(kind).tobytes(), np.cumsum(n) * np.dtype(kind).itemsize
            data = [found[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(words), pa.array(n.astype(np.int64)), pa.array(data, pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    ids = F.col(f"`{keep}`").cast("long") if keep else F.lit(None).cast("long")
    texts = df.select(ids.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(find, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket."""
    kind = _kind(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("buckets").to_pylist()), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, got = np.zeros(buckets, np.int64), rows.toArrow()  # at most one row a bucket
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    b = float(len(corpus))
    ratio = (target + 1.0) * (float(corpus.sum()) + b) / ((corpus + 1.0) * (float(target.sum()) + b))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``found`` with ``weight``: the mean gain of the row's features, rounded down (without features 0), in place of the buckets."""
    kind = _kind(len(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            each = gain[np.frombuffer(b"".join(batch.column("buckets").to_pylist()), kind)]
            upto = np.append(0, np.cumsum(each))
            ends = np.cumsum(n)
            total = upto[ends] - upto[ends - n]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def placed(df: DataFrame, order: list) -> tuple[DataFrame, int]:
    """``df`` with ``place``, its place from 1 in ``order``, and the number of rows: ranges of the order, each after the rows of those before it."""
    at, here = F.monotonically_increasing_id(), (1 << 33) - 1
    inside = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ordered")
    inside = inside.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(here))
    sizes = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shuffle partition
    bases = sizes.select("_part", "_n", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    rows = inside.join(F.broadcast(bases.drop("_n")), "_part").withColumn("place", F.col("_base") + F.col("_row") + 1)
    return rows.select(*df.columns, "place"), sizes.agg(F.sum("_n")).first()[0] or 0


def resample(docs: DataFrame, target: DataFrame, percent: int, low: int = 1, high: int = 1, buckets: int = 10_000, least: int = 20, seed: int = 2024) -> DataFrame:
    """Every document's n_features, weight and score, and the rank of those drawn: ``percent`` of a hundred of the documents with ``least`` words or more."""
    small_batches(docs.sparkSession)
    found = saved(bucketed(docs, low, high, buckets, "doc_id"), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(bucketed(only(target, "text"), low, high, buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed(found, gain).withColumn("score", F.col("weight") + draw).withColumn("_tie", F.monotonically_increasing_id())
    scored = saved(scored, "scored")
    enough, columns = F.col("n_words") >= least, ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie").asc()]
    rows, n = placed(scored.where(enough).select(*columns, "_tie"), order)
    drawn = F.when(F.col("place") <= percent * n // 100, F.col("place")).cast("long")
    rest = scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank"))
    return rows.select(*columns, drawn.alias("rank")).unionByName(rest)
