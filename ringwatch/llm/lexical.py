"""Ranked lexical search: an inverted index of compressed posting blocks with their greatest impacts, searched as in Block-Max WAND.

Terms are maximal runs of letters and digits, A-Z lower-cased. The index is a table of segments; a segment is a block of texts. It has a
row for each of its terms, (segment, term, df, heads, data), and one without a term for its documents (ids, and the length term m of each).
The postings of a term, in order of the documents of the segment, are cut into blocks of ``BLOCK``. A block holds gaps
and counts in one, two or four bytes each, as its largest need; its head holds the last document, the greatest impact and both
widths, so a block's reach and bound are known without reading it.

A query meets a segment so: the pointers of all its terms move over the heads alone (shallow moves); where they stand, the sum
of w * greatest impact bounds every document up to the next end of a block. Documents in stretches whose bound is below the threshold (the
k-th best score so far, or a floor from other segments) are skipped with their blocks. Then the terms move deep, the rarest first:
blocks that hold a document still above the threshold are decompressed, once for all queries, and the impact found takes the place of the block's greatest in
the document's bound. Documents with the highest bounds are scored first now and then, so that the threshold rises
early. No skipped document can be among the k best, ties included, so results are exact.

Queries are asked in blocks of about ``ITEMS``; the driver holds the terms of one such block. A sixteenth of the segments is searched first; the k-th
best scores found there are the floors of the others. What leaves a segment is at most k rows a query.

Nulls: a row with a null doc_id or item_id takes no part; a null text has no terms. Texts without terms count neither in N nor in L. Repeated rows are documents
(or items) of their own. Ties go to the smaller doc_id. A very long text is a segment of its own. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.llm.common import saved, small_batches
from ringwatch.llm.words import MARK, merged, split_words, strings, utf8

BLOCK, ITEMS = 128, 256
#: Bytes of text in a segment.
SEGMENT = 8 << 20
_HEAD = np.dtype([("end", "<u4"), ("peak", "<u4"), ("gaps", "u1"), ("counts", "u1")])
#: Documents scored at a time to raise the threshold.
TURN = 64


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth in a document of length term m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def n_terms(texts: pa.Array) -> np.ndarray:
    """Terms of each text, repeats included."""
    raw, offsets = utf8(texts)
    if not len(raw):
        return np.zeros(len(texts), np.int64)
    mark = MARK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = ~mark
    start[1:] &= mark[:-1] | edge[1:-1]
    return np.diff(np.searchsorted(np.flatnonzero(start), offsets))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        for batch in batches:
            each = n_terms(batch.column("text"))
            n, size = n + int((each > 0).sum()), size + int(each.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "size": [size]})

    row = docs.select("text").mapInArrow(count, "n long, size long").agg(F.sum("n"), F.sum("size")).first()
    return row[0] or 0, row[1] or 0


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)


def _put(out: np.ndarray, base: np.ndarray, width: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
    """Writes each value, in ``width`` bytes, as number ``place`` from byte ``base`` on."""
    for w in (1, 2, 4):
        at = np.flatnonzero(width == w)
        to = base[at] + place[at] * w
        for b in range(w):
            out[to + b] = (value[at] >> (8 * b)) & 255


def packed(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, worth: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of term and document, compressed: df of each of ``n`` terms, all heads and heads a term, all bytes and bytes a term."""
    df = np.bincount(term, minlength=n)
    first = np.cumsum(df) - df
    inside = np.arange(len(term)) - first[term]
    starts = np.flatnonzero(inside % BLOCK == 0)
    block = np.cumsum(inside % BLOCK == 0) - 1
    gap = doc - np.append(-1, doc[:-1])
    gap[inside == 0] = doc[inside == 0] + 1
    heads = np.zeros(len(starts), _HEAD)
    if len(starts):
        heads["end"] = doc[np.append(starts[1:], len(doc)) - 1]
        heads["peak"] = np.maximum.reduceat(worth, starts)
        heads["gaps"], heads["counts"] = _width(np.maximum.reduceat(gap, starts)), _width(np.maximum.reduceat(tf, starts))
    size = np.diff(np.append(starts, len(doc)))
    gaps, counts = heads["gaps"].astype(np.int64), heads["counts"].astype(np.int64)
    upto = np.cumsum(size * (gaps + counts))
    base = upto - size * (gaps + counts)
    out = np.zeros(int(upto[-1]) if len(upto) else 0, np.uint8)
    place = inside % BLOCK
    _put(out, base[block], gaps[block], place, gap)
    _put(out, (base + size * gaps)[block], counts[block], place, tf)
    blocks = -(-df // BLOCK)
    last = np.cumsum(blocks)
    ends = np.append(0, upto)
    return df, heads, blocks, out, ends[last] - ends[last - blocks]


def segment(batch: pa.RecordBatch, n_docs: int, n_all: int) -> pa.Table:
    """(term, df, heads, data) of a block of texts; the row without term has the documents' ids and length terms."""
    ids, words, counts = split_words(batch.column("text"), between=MARK)
    n = len(counts)
    m = 10 + 90 * counts * n_docs // max(n_all, 1)
    rows = np.repeat(np.arange(n), counts)
    pairs, tf = np.unique(ids.astype(np.int64) * n + rows, return_counts=True)
    term, doc = pairs // max(n, 1), pairs % max(n, 1)
    df, heads, blocks, data, sizes = packed(term, doc, tf, impact(tf, m[doc]), len(words))
    doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8")
    columns = [
        pa.concat_arrays([pa.array([None], pa.string()), words.cast(pa.large_string()).cast(pa.string())]),
        pa.array(np.append(n, df).astype(np.int64)),
        pa.concat_arrays([pa.array([doc_ids.tobytes()], pa.binary()), strings(heads.view(np.uint8), blocks * _HEAD.itemsize).cast(pa.binary())]),
        pa.concat_arrays([pa.array([m.astype("<i8").tobytes()], pa.binary()), strings(data, sizes).cast(pa.binary())]),
    ]
    return pa.table(columns, names=["term", "df", "heads", "data"])


class Index:
    """The segments of a corpus, its number of documents with terms and of all their terms."""

    def __init__(self, segments: DataFrame, n: int, size: int):
        self.segments, self.n, self.size = segments, n, size


def build(docs: DataFrame) -> Index:
    """Indexes every row with a doc_id."""
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, size = totals(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, batch in enumerate(merged(batches, "text", SEGMENT)):
            rows = segment(batch, n, size)
            own = pa.array(np.full(len(rows), (task << 24) + number))
            yield from rows.add_column(0, "segment", own).to_batches(max_chunksize=20_000)

    return Index(saved(docs.mapInArrow(cut, "segment long, term string, df long, heads binary, data binary"), "index"), n, size)


class Postings:
    """One term's blocks in a segment; decompressed when a document in them is asked for."""

    def __init__(self, df: int, heads: bytes, data: bytes, m: np.ndarray):
        self.heads, self.m = np.frombuffer(heads, _HEAD), m
        self.data = np.frombuffer(data, np.uint8)
        self.end, self.peak = self.heads["end"].astype(np.int64), self.heads["peak"].astype(np.int64)
        self.size = np.full(len(self.heads), BLOCK)
        self.size[-1] = df - BLOCK * (len(self.heads) - 1)
        length = self.size * (self.heads["gaps"].astype(np.int64) + self.heads["counts"])
        self.base = np.cumsum(length) - length
        self.first = np.append(0, self.end[:-1] + 1)  # the first document a block may hold
        self.open = np.zeros(len(self.heads), bool)
        self.doc = np.repeat(self.end, self.size)  # in order, whether a block is open or not
        self.worth = np.zeros(df, np.int64)

    def unpack(self, b: int) -> None:
        n, at, h = int(self.size[b]), int(self.base[b]), self.heads[b]
        middle = at + n * int(h["gaps"])
        gap = self.data[at:middle].view(f"<u{h['gaps']}").astype(np.int64)
        tf = self.data[middle : middle + n * int(h["counts"])].view(f"<u{h['counts']}").astype(np.int64)
        run = slice(b * BLOCK, b * BLOCK + n)
        self.doc[run] = np.cumsum(gap) + (self.end[b - 1] if b else -1)
        self.worth[run] = impact(tf, self.m[self.doc[run]])
        self.open[b] = True

    def refined(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``docs`` (in order): the greatest impact of the block it falls in (0 after the last), and its own (0 where the term does not occur)."""
        cuts = docs.searchsorted(self.end, side="right")
        counts = cuts.copy()
        counts[1:] -= cuts[:-1]
        for b in ((counts > 0) & ~self.open).nonzero()[0].tolist():
            self.unpack(b)
        peaks, own = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        peaks[: cuts[-1]] = self.peak.repeat(counts)
        if not len(docs):
            return peaks, own
        if len(self.doc) <= len(docs):  # the shorter list is looked up in the longer
            at = np.minimum(docs.searchsorted(self.doc), len(docs) - 1)
            hit = docs[at] == self.doc
            own[at[hit]] = self.worth[hit]
        else:
            at = np.minimum(self.doc.searchsorted(docs), len(self.doc) - 1)
            hit = self.doc[at] == docs
            own[hit] = self.worth[at[hit]]
        return peaks, own

    def worths(self, docs: np.ndarray) -> np.ndarray:
        """Impacts in a few ``docs``; 0 where the term does not occur."""
        block = self.end.searchsorted(docs)
        for b in set(block.tolist()):
            if b < len(self.open) and not self.open[b]:
                self.unpack(b)
        at = np.minimum(self.doc.searchsorted(docs), len(self.doc) - 1)
        return np.where(self.doc[at] == docs, self.worth[at], 0)


def best(terms: list[tuple[int, Postings]], ids: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The k documents of a segment with the highest scores of at least ``floor`` (and above 0), and their scores."""
    bound = np.zeros(len(ids) + 1, np.int64)
    for w, p in terms:  # shallow moves: heads only
        np.add.at(bound, p.first, w * p.peak)
        np.add.at(bound, p.end + 1, -w * p.peak)
    bound = np.cumsum(bound)[:-1]
    low, turn = max(floor, 1), max(TURN, k)
    docs = np.flatnonzero(bound >= low)
    bound = bound[docs]
    for i, (w, p) in enumerate(sorted(terms, key=lambda t: len(t[1].doc))):
        if i in (0, len(terms) // 4, len(terms) // 2) and len(docs) > 2 * turn:  # the most promising documents raise the threshold
            some = np.sort(docs[np.argpartition(-bound, turn)[:turn]])
            total = sum(w_ * p_.worths(some) for w_, p_ in terms)
            low = max(low, int(np.partition(total, turn - k)[turn - k]))
            keep = bound >= low
            docs, bound = docs[keep], bound[keep]
        peaks, own = p.refined(docs)
        bound = bound + w * (own - peaks)
        keep = bound >= low
        docs, bound = docs[keep], bound[keep]
    order = np.lexsort((ids[docs], -bound))[:k]
    return ids[docs[order]], bound[order]


def asked(items: DataFrame) -> DataFrame:
    """(number, item_id, block, term) of every item's distinct terms; items are dealt to blocks of about ``ITEMS``."""
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = saved(items.withColumn("number", F.monotonically_increasing_id()), "items")
    blocks = max(1, items.count() // ITEMS)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, counts = split_words(batch.column("text"), between=MARK)
            row, word = np.divmod(np.unique(np.repeat(np.arange(len(counts)), counts) * max(len(words), 1) + ids), max(len(words), 1))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("number", "item_id")] + [words.cast(pa.large_string()).cast(pa.string()).take(pa.array(word))], names=["number", "item_id", "term"])

    each = items.select("number", "item_id", "text").mapInArrow(terms, "number long, item_id long, term string")
    return saved(each.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")), "terms")


def found(segments: DataFrame, terms: DataFrame, queries: dict[int, list[tuple[str, int]]], k: int, floors: dict[int, int], tasks: int) -> DataFrame:
    """(number, doc_id, score): the best k of every query in each of ``segments``, which are dealt to ``tasks`` (few bytes, much work)."""
    met = segments.join(F.broadcast(terms), "term", "left_semi").unionByName(segments.where("term is null")).repartition(tasks, "segment")

    def search(rows: pa.Table) -> pa.Table:
        term = rows.column("term").to_pylist()
        columns = [rows.column(c).to_pylist() for c in ("df", "heads", "data")]
        own = term.index(None)
        ids, m = (np.frombuffer(columns[c][own], "<i8") for c in (1, 2))
        here = {t: Postings(*row, m) for t, *row in zip(term, *columns, strict=True) if t is not None}
        out = [[], [], []]
        for number, weights in queries.items():
            held = [(w, here[t]) for t, w in weights if t in here]
            if held and sum(w * int(p.peak.max()) for w, p in held) >= max(1, floors.get(number, 1)):
                doc, score = best(held, ids, k, floors.get(number, 1))
                for column, values in zip(out, (np.full(len(doc), number), doc, score), strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["number", "doc_id", "score"])

    return met.groupBy("segment").applyInArrow(search, "number long, doc_id long, score long")


def top(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score."""
    terms = asked(items)
    wanted = terms.select("term").distinct()
    df = saved(index.segments.where("term is not null").select("term", "df").join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    known, parts = terms.join(df, "term"), []
    first = F.pmod(F.xxhash64("segment"), F.lit(16)) == 0
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.segments.where("term is null").count() // 4)
    for block in sorted(r["block"] for r in terms.select("block").distinct().collect()):
        queries: dict[int, list[tuple[str, int]]] = {}
        for r in known.where(F.col("block") == block).orderBy("number", "term").collect():
            if w := weight(index.n, r["df"]):
                queries.setdefault(r["number"], []).append((r["term"], w))
        own = terms.where(F.col("block") == block).select("term").distinct()
        some = saved(found(index.segments.where(first), own, queries, k, {}, tasks), "found")
        floors = {r["number"]: r["score"] for r in top(some, k).where(F.col("rank") == k).collect()}
        parts += [some, saved(found(index.segments.where(~first), own, queries, k, floors, tasks), "found")]
    if not parts:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = terms.select("number", "item_id").distinct()
    return top(rows, k).join(names, "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
