"""Exact Jaccard self-join of shingle sets: universe partition and pigeonhole.

A document's set is its distinct shingles of ``words`` words. Sets are grouped in bands of size so
that a linked pair lies in one band or in two next to each other. In the scheme of a band the
universe of shingles is hashed into ``m`` segments; a pair that differs in at most ``H`` shingles
agrees on one of any ``H + 1`` segments, so equal subsets of one segment (a signature) propose a pair.
Allocation by cost: empty segments and signatures shared by many unconnected sets are left out
as long as H + 1 others stay (a few spare segments are there for that). Sets for which too few stay are
"laden": they are indexed again with half as many, twice as long segments and the one-deletion
neighbourhood of each, which tolerates one difference a segment. A pair is lost only if it
were laden on both sides in one index and met in no other, and each index covers all laden sets.

Proposed pairs pass an odd sketch (parities of hashed shingles: its differing bits never exceed
the differing shingles, so nothing linked is lost) and then the exact comparison of the sets.
The first round compares each member of a bucket with one centre only. In the second, the remaining pairs
of different components that sketches don't rule out gather sets in clusters (as stars, at most a row for each set
in a task, since near copies would make rows by the square), and the sets of a cluster are compared block against block,
which settles the components. As a link never leaves its
component, ``join`` and ``links`` then compare all classes (distinct sets) of each component of three or more, block
against block; ``groups`` leaves that out.

Nulls: a null text or one without words has an empty set and no links; rows with a null doc_id are left out. Repeated doc_ids are one
document, with the text whose (set size, set hash) is least. A very long text is one row with a large set; what a task holds is bounded by
batches of bytes. Pairs that just reach the limit are linked, and the smallest doc_id names a component or class.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import only, ranked, salt, saved, small_batches
from ringwatch.llm.graph import classes, components
from ringwatch.llm.words import hashed, merged, mixed, split_words, strings

_U = np.uint64
#: The two halves of a set's hash: sums of hashed elements.
_HASHES = (("h1", 0), ("h2", 0x2545F4914F6CDD1D))
#: Buckets with more components than this are left out where the allocation can spare them.
CROWD = 48
#: A block has at most so many sets, and at most twice so many elements (or one set).
BLOCK, ROOM = 1024, 1 << 19


class Scheme:
    """Bands, segments and spare segments for ``percent`` of the union in common."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            a = self.low[-1]
            self.low.append(max(a + 1, (a - 1) * 100 // self.percent + 1))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def differ(self, total: int) -> int:
        """Most differing elements of a linked pair whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def segments(self, band: int) -> tuple[int, int]:
        """(H, m) of a band's scheme."""
        self.band(self.low[-1] if band + 1 >= len(self.low) else 1)
        s = self.low[band + 1] - 1
        h = self.differ(s + s * 100 // self.percent)
        return h, h + 1 + (1 + (h + 1) // 8 if h else 0)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending within a text, and how many each text has."""
    index, dictionary, counts = split_words(texts)
    w = hashed(dictionary)[index] if len(index) else np.zeros(0, _U)
    x = mixed(w)
    for i in range(1, words):
        x = mixed(x[: len(x) - 1] + w[i:]) if len(x) > 1 else x[:0]
    starts = np.cumsum(counts) - counts
    per = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    place = np.cumsum(per) - per
    total = int(per.sum())
    if not total:
        return np.zeros(0, _U), per
    flat = x[np.minimum(np.repeat(starts - place, per) + np.arange(total), len(x) - 1)] if len(x) else np.zeros(total, _U)
    for i in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        v = _U(counts[i])
        with np.errstate(over="ignore"):
            for y in w[starts[i] : starts[i] + counts[i]]:
                v = mixed(np.array([v + y]))[0]
        flat[place[i]] = v
    for a, n in zip(place.tolist(), per.tolist(), strict=True):
        if n > 1:
            flat[a : a + n].sort()
    new = np.ones(total, bool)
    new[1:] = flat[1:] != flat[:-1]
    new[place[per > 0]] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    return flat[new], upto[place + per] - upto[place]


def set_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, of the values of each set; 0 for an empty one."""
    out, some = np.zeros(len(sizes), _U), np.flatnonzero(sizes)
    if len(some):
        with np.errstate(over="ignore"):
            out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def odd_sketches(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parities of each set's elements over a power of two of bits, about 2 for each element (64 at least)."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    base = np.cumsum(bits) - bits
    at = np.repeat(base, sizes) + (mixed(flat + _U(0x9E3779B97F4A7C15)) & (np.repeat(bits, sizes) - 1).astype(_U)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8))
    return strings(raw, bits // 8).cast(pa.binary())


def distances(a: pa.Array, ia: np.ndarray, b: pa.Array, ib: np.ndarray) -> np.ndarray:
    """Differing bits of the sketches ``a[ia]`` and ``b[ib]``, the longer folded to the length of the shorter."""
    sides = []
    for column, at in ((a, ia), (b, ib)):
        wide = column.cast(pa.large_binary())
        offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
        raw = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
        sides.append((raw, offsets[:-1][at], np.diff(offsets)[at]))
    (ra, fa, na), (rb, fb, nb) = sides
    out, kind = np.zeros(len(ia), np.int64), na * (1 << 32) + nb
    for k in np.unique(kind).tolist():
        same = np.flatnonzero(kind == k)
        for part in np.array_split(same, max(1, len(same) * max(k >> 32, k & 0xFFFFFFFF) // (1 << 21))):
            x, y = ra[fa[part][:, None] + np.arange(k >> 32)], rb[fb[part][:, None] + np.arange(k & 0xFFFFFFFF)]
            # Bit i of a sketch half as long is the parity of bits i and i + half.
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _keys(sums: np.ndarray, segment: np.ndarray, band: np.ndarray, kind: int) -> np.ndarray:
    """Signatures: even in schemes of even bands, odd in the others."""
    with np.errstate(over="ignore"):
        salt = mixed(segment.astype(_U) + (band.astype(_U) << _U(32)) + _U(kind << 60))
        return (mixed(sums ^ salt) & ~_U(1)) | (band & 1).astype(_U)


def _segment(x: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """Segment of each element: ranges of the hashed universe, so a set in order has its segments in order."""
    return (((x >> _U(32)) * np.asarray(m).astype(_U)) >> _U(32)).astype(np.int64)


def signatures(flat: np.ndarray, sizes: np.ndarray, scheme: Scheme, laden: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets in the schemes of their bands and the ones below, the set of each, and spares (even, odd) of each set."""
    n = len(sizes)
    spares = np.zeros((n, 2), np.int64)
    if not len(flat):
        return np.zeros(0, _U), np.zeros(0, np.int64), spares
    scheme.band(int(sizes.max()) + 1)
    each = np.array([scheme.segments(b) for b in range(scheme.band(int(sizes.max())) + 1)], np.int64)
    own = np.searchsorted(scheme.low, sizes, "right") - 1
    row, value = np.repeat(np.arange(n), sizes), mixed(flat + _U(0xA0761D6478BD642F))
    keys, rows = [], []
    for band in (own, own - 1):
        live = (band >= 0) & (sizes > 0)
        h, full = each[np.maximum(band, 0)].T
        m = np.maximum(1, (full + 1) // 2) if laden else full
        at = live[row]
        x, v, r = flat[at], value[at], row[at]
        if not len(x):
            continue
        segment = _segment(x, m[r])
        first = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (r[1:] != r[:-1])))
        held = np.diff(np.append(first, len(x)))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(v, first)
            of, seg = r[first], segment[first]
            keys.append(_keys(sums, seg, band[of], 1 + laden))
            rows.append(of)
            cover = np.bincount(of, minlength=n)
            if laden:
                two = np.repeat(held > 1, held)
                keys.append(_keys((np.repeat(sums, held) - v)[two], segment[two], band[r[two]], 2))
                rows.append(r[two])
                cover = cover + np.bincount(of[held > 1], minlength=n)
        # Too few segments hold anything: such sets also meet with their empty segments.
        begin = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(live & (cover < h + 1)).tolist():
            sums = np.zeros(full[i], _U)
            with np.errstate(over="ignore"):
                np.add.at(sums, _segment(flat[begin[i] : begin[i] + sizes[i]], int(full[i])), value[begin[i] : begin[i] + sizes[i]])
            keys.append(_keys(sums, np.arange(full[i]), np.full(full[i], band[i]), 4 + laden))
            rows.append(np.full(full[i], i))
        spares[np.arange(n), band & 1] = np.where(live, np.maximum(0, cover - h - 1), 0)
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return np.concatenate(keys)[order], rows[order], spares


def describe(docs: DataFrame, words: int, scheme: Scheme) -> DataFrame:
    """doc_id, set size, 128-bit set hash, odd sketch and spare segments of the two schemes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", 2 << 20):
            flat, sizes = shingle_sets(batch.column("text"), words)
            _, _, spares = signatures(flat, sizes, scheme, False)
            one, two = (pa.array(set_sums(mixed(flat ^ _U(c)), sizes).view(np.int64), mask=sizes == 0) for _, c in _HASHES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    one,
                    two,
                    odd_sketches(flat, sizes),
                    pa.array(spares[:, 0], pa.int32()),
                    pa.array(spares[:, 1], pa.int32()),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "sketch", "spare_even", "spare_odd"],
            )

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary, spare_even int, spare_odd int")


def _as_known(batch: pa.RecordBatch, words: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids and sets of the rows whose set is the one that (h1, h2) names: a repeated doc_id has one text."""
    flat, sizes = shingle_sets(batch.column("text"), words)
    same = [set_sums(mixed(flat ^ _U(c)), sizes).view(np.int64) == batch.column(n).to_numpy() for n, c in _HASHES]
    ok = same[0] & same[1]
    return batch.column("doc_id").cast(pa.int64()).filter(pa.array(ok)), flat[np.repeat(ok, sizes)], sizes[ok]


def index(docs: DataFrame, words: int, scheme: Scheme, laden: bool) -> DataFrame:
    """(sig, h1, centre) of the distinct sets, named by the first half of their hash, for signatures that at least two share.

    Should two sets have the same name, both are proposed wherever it stands. Spark sorts the signatures (and spills); a task then streams
    them, passes repeats of a set over and holds one batch.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", 2 << 20):
            _, flat, sizes = _as_known(batch, words) if laden else (None, *shingle_sets(batch.column("text"), words))
            name = set_sums(mixed(flat), sizes)
            new = np.zeros(len(sizes), bool)
            new[np.unique(name, return_index=True)[1]] = True
            flat, sizes, name = flat[np.repeat(new, sizes)], sizes[new], name[new]
            keys, of, _ = signatures(flat, sizes, scheme, laden)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(name[of].view(np.int64))], names=["sig", "h1"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The run that the batch before ended in, its first and last set, and whether its only row is still to come.
        last, centre, end, waits = None, 0, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, doc = batch.column("sig").to_numpy(), batch.column("h1").to_numpy()
            new = np.append(last is None or (sig[0], doc[0]) != (last, end), (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]))
            sig, doc = sig[new], doc[new]
            if not len(sig):
                continue
            starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            sizes = np.diff(np.append(starts, len(sig)))
            lead, multi = np.repeat(doc[starts], sizes), np.repeat(sizes > 1, sizes)
            goes_on = last is not None and last == sig[0]
            if goes_on:
                lead[: sizes[0]], multi[: sizes[0]] = centre, True
                if waits:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (last, centre, centre)], names=["sig", "h1", "centre"])
            last, centre, end, waits = int(sig[-1]), int(lead[-1]), int(doc[-1]), not multi[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[multi]) for x in (sig, doc, lead)], names=["sig", "h1", "centre"])

    rows = docs.mapInArrow(emit, "sig long, h1 long")
    return saved(rows.repartition("sig").sortWithinPartitions("sig", "h1").mapInArrow(shared, "sig long, h1 long, centre long"), "shared")


def close(pairs: DataFrame, known: DataFrame, scheme: Scheme) -> DataFrame:
    """The (a, b) pairs that sizes and odd sketches don't rule out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            at = np.flatnonzero(np.minimum(na, nb) * 100 >= np.maximum(na, nb) * scheme.percent)
            apart = distances(batch.column("sa"), at, batch.column("sb"), at)
            yield batch.select(["a", "b"]).take(pa.array(at[apart <= scheme.differ((na + nb)[at])]))

    side = lambda c: known.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(near, "a long, b long")


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two ascending sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)) if len(x) else 0


def loaded(wanted: DataFrame, docs: DataFrame, least: DataFrame, words: int) -> DataFrame:
    """(doc_id, elements): the sets of the wanted documents."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", 2 << 20):
            ids, flat, sizes = _as_known(batch, words)
            yield pa.RecordBatch.from_arrays([ids, strings(flat.view(np.uint8), sizes * 8).cast(pa.binary())], names=["doc_id", "elements"])

    return saved(docs.join(least.join(wanted, "doc_id", "left_semi"), "doc_id").mapInArrow(load, "doc_id long, elements binary"), "sets")


def verify(pairs: DataFrame, docs: DataFrame, least: DataFrame, words: int, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """The pairs whose whole sets are similar enough, and the sets of all proposed documents."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
                both = in_common(x, y)
                ok.append(100 * both >= scheme.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = saved(pairs, "proposed")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = loaded(wanted, docs, least, words)
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("elements").alias(f"x{c}"))
    return saved(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "a long, b long"), "links"), sets


def alike(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each set of ``x`` is similar enough to each set of ``y``."""
    nx, ny = (np.array([len(v) for v in side], np.int64) for side in (x, y))
    both = np.zeros((len(x), len(y)), np.int64)
    if both.size <= 16:
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                both[i, j] = in_common(a, b)
    else:
        ex, ey = np.concatenate(x), np.concatenate(y)
        common = np.intersect1d(ex, ey)

        def entries(e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(common, e)
            hit = np.flatnonzero(np.append(common, _U(0))[at] == e)
            hit = hit[at[hit] < len(common)]
            hit = hit[np.argsort(at[hit], kind="stable")]
            return np.repeat(np.arange(len(n)), n)[hit], at[hit]

        (rx, cx), (ry, cy) = entries(ex, nx), entries(ey, ny)
        width = max(256, (1 << 22) // (len(x) + len(y)))
        for a in range(0, len(common), width):
            dense = []
            for r, c, n in ((rx, cx, len(x)), (ry, cy, len(y))):
                low, high = np.searchsorted(c, [a, a + width])
                held = np.zeros((n, min(width, len(common) - a)), np.float32)
                held[r[low:high], c[low:high] - a] = 1
                dense.append(held)
            both += np.rint(dense[0] @ dense[1].T).astype(np.int64)
    return 100 * both >= percent * (nx[:, None] + ny[None, :] - both)


def meetings(member: DataFrame, key: str, scheme: Scheme) -> DataFrame:
    """(key, i, j, side, doc_id): the members of each key dealt to blocks in order of size, each block (side 0) with
    itself (i = j) and with every other (side 1) whose sizes don't rule a link out."""
    member = member.select(key, "doc_id", "n_shingles").withColumn("scale", F.floor(F.log2("n_shingles")).cast("int"))
    bucket = F.col("n_shingles") * 64 + salt([F.col("doc_id")], 64)
    member = ranked(member, [key, "scale"], [F.col("n_shingles"), F.col("doc_id")], bucket)
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(ROOM) / F.pow(F.lit(2), F.col("scale")))))
    member = saved(member.withColumn("block", F.col("scale").cast("long") * (1 << 40) + F.floor(F.col("rank") / room).cast("long")), "members")
    sizes = member.groupBy(key, "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    meets = sizes.select(key, F.col("block").alias("i"), "high").join(sizes.select(key, F.col("block").alias("j"), "low"), key)
    meets = saved(meets.where((F.col("i") <= F.col("j")) & (F.col("high") * 100 >= F.col("low") * scheme.percent)).select(key, "i", "j"), "meets")
    side = lambda c, n: member.withColumnRenamed("block", c).join(meets, [key, c]).select(key, "i", "j", F.lit(n).alias("side"), "doc_id")
    return side("i", 0).unionByName(side("j", 1).where("i < j"))


def by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of whole groups, of batches sorted by ``keys``; several groups at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        end = [held[c][-1].as_py() for c in keys]
        if [batch.column(c)[0].as_py() for c in keys] == end:
            continue  # the last group may go on
        last = np.ones(held.num_rows, bool)
        for c, v in zip(keys, end, strict=True):
            last &= held[c].to_numpy() == v
        start = int(np.argmax(last))
        if start:
            yield held.slice(0, start)
        held = held.slice(start)
    if held is not None:
        yield held


def _starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    columns = np.stack([table[c].to_numpy() for c in keys])
    return np.flatnonzero(np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0)))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' connected components: each least member with each other member."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        new, low = label.copy(), np.minimum(label[x], label[y])
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[label[other]], names[other]


def spanning(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest that joins what the symmetric matrix ``ok`` joins."""
    out, open_ = [], ok.any(axis=1)
    for root in np.flatnonzero(open_).tolist():
        todo = [root] if open_[root] else []
        open_[root] = False
        while todo:
            at = todo.pop()
            new = np.flatnonzero(ok[at] & open_).tolist()
            open_[new] = False
            out += [(at, n) for n in new]
            todo += new
    return out


def settle(proposed: DataFrame, label: DataFrame, rep: DataFrame, docs: DataFrame, least: DataFrame, words: int, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """Links that join whatever links between components the clusters of proposed pairs hold, and the clusters' sets.

    All sets of a cluster meet, block against block; of a meeting's links those of a spanning forest stay.
    """
    member = saved(components(proposed).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    sets = loaded(member, docs, least, words)
    rows = meetings(member.join(rep.select("doc_id", "n_shingles"), "doc_id"), "cluster", scheme)
    rows = rows.join(label.select("doc_id", "component"), "doc_id").join(sets, "doc_id")
    keys = ("cluster", "i", "j")

    def linked(group: pa.Table) -> pa.RecordBatch:
        side, doc, part = (group[c].to_numpy() for c in ("side", "doc_id", "component"))
        elements = [np.frombuffer(e.as_buffer(), _U) for e in group["elements"]]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = not len(y)
        y = x if own else y
        ok = np.zeros((len(doc), len(doc)), bool)
        ok[np.ix_(x, y)] = alike([elements[i] for i in x.tolist()], [elements[i] for i in y.tolist()], scheme.percent) & (part[x][:, None] != part[y][None, :])
        edges = np.array(spanning(ok if own else ok | ok.T), np.int64).reshape(-1, 2)
        ends = np.sort(doc[edges], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, keys):
            starts = _starts(table, keys).tolist()
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                yield linked(table.slice(a, b - a))

    dealt = rows.select("cluster", "i", "j", "side", "doc_id", "component", "elements").repartition(*keys).sortWithinPartitions(*keys)
    return saved(dealt.mapInArrow(compare, "a long, b long"), "links"), sets


def every_link(found: DataFrame, parts: DataFrame, rep: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """(class_id, near): classes and arrays of classes linked to them; several rows for a class in several block pairs.

    A component of two classes is its one known link. In the others, classes are dealt to blocks in
    order of size, and each block meets those whose sizes don't rule a link out. Every link stands in both its classes' rows.
    """
    many = saved(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("component"), "many")
    two = found.distinct().join(parts.withColumnRenamed("node", "a"), "a").join(many, "component", "left_anti")
    two = two.selectExpr("stack(2, a, b, b, a) as (class_id, other)").select("class_id", F.array("other").alias("near"))
    member = parts.withColumnRenamed("node", "doc_id").join(many, "component").join(rep.select("doc_id", "n_shingles"), "doc_id")
    rows = meetings(member, "component", scheme).join(sets, "doc_id")
    keys = ("component", "i", "j")

    def near(group: pa.Table) -> pa.RecordBatch:
        held: list[dict[int, np.ndarray]] = [{}, {}]
        for n, doc, e in zip(group["side"].to_pylist(), group["doc_id"].to_pylist(), group["elements"], strict=True):
            held[n].setdefault(doc, np.frombuffer(e.as_buffer(), _U))
        x, y = held
        own = not y
        ids, others = np.array(list(x), np.int64), np.array(list(x if own else y), np.int64)
        ok = alike(list(x.values()), list(x.values() if own else y.values()), scheme.percent)
        if own:
            np.fill_diagonal(ok, False)
        one, lists = [], []
        for left, right, hit in ((ids, others, ok),) if own else ((ids, others, ok), (others, ids, ok.T)):
            some = np.flatnonzero(hit.any(axis=1))
            one.append(left[some])
            lists += [right[hit[i]] for i in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(lists, pa.list_(pa.int64()))], names=["class_id", "near"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, keys):
            starts = _starts(table, keys).tolist()
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                yield near(table.slice(a, b - a))

    dealt = rows.select("component", "i", "j", "side", "doc_id", "elements").repartition(*keys).sortWithinPartitions(*keys)
    return saved(two.unionByName(dealt.mapInArrow(compare, "class_id long, near array<long>")), "near")


def proposals(rows: DataFrame, rep: DataFrame, scheme: Scheme) -> DataFrame:
    """Stars (a, b) of what pairs of different components within each signature join, pairs that sketches don't rule out.

    ``rows`` has (sig, doc_id, component). A signature with more than ``BLOCK`` sets is dealt to blocks.
    """
    keys = ("sig", "i", "j")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, keys):
            starts = _starts(table, keys)
            doc, part, n, side, i, j = (table[c].to_numpy() for c in ("doc_id", "component", "n_shingles", "side", "i", "j"))
            ends = np.repeat(np.append(starts[1:], len(doc)), np.diff(np.append(starts, len(doc))))
            sketch, place, left = table["sketch"].combine_chunks(), np.arange(len(doc)), []
            for step in range(1, int((ends - place).max(initial=1))):
                a = place[ends - place > step]
                b = a + step
                ok = (part[a] != part[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * scheme.percent)
                ok &= (i[a] == j[a]) | (side[a] != side[b])
                left.append(np.stack([a[ok], b[ok]]))
            if not left:
                continue
            a, b = np.concatenate(left, axis=1)
            # The same pair may meet under many signatures.
            pair = np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])])
            pair, first = np.unique(pair, axis=1, return_index=True)
            a, b = a[first], b[first]
            ok = distances(sketch, a, sketch, b) <= scheme.differ(n[a] + n[b])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(pair[0][ok], pair[1][ok])], names=["a", "b"])

    big = saved(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("sig"), "big")
    zero = [F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side")]
    facts = rep.select("doc_id", "n_shingles", "sketch")
    all_rows = rows.select("sig", "doc_id", "component", *zero)
    if not big.isEmpty():
        dealt = meetings(rows.join(big, "sig", "left_semi").join(rep.select("doc_id", "n_shingles"), "doc_id"), "sig", scheme)
        dealt = dealt.join(rows.select("doc_id", "component").distinct(), "doc_id")
        all_rows = all_rows.join(big, "sig", "left_anti").unionByName(dealt.select(*all_rows.columns))
    ready = all_rows.join(facts, "doc_id").select("sig", "i", "j", "side", "doc_id", "component", "n_shingles", "sketch")
    return ready.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(cross, "a long, b long").distinct()


def mixed_buckets(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of the signatures whose documents lie in several components, one row a component's document."""
    named = shared.select("sig", "h1").join(label, "h1")
    sizes = named.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.approx_count_distinct("component").alias("parts"))
    return saved(named.join(sizes.where("least <> most"), "sig").select("sig", "doc_id", "component", "parts"), "mixed")


def _matched(docs: DataFrame, words: int, scheme: Scheme) -> tuple[DataFrame, ...]:
    """Facts of every document, components of linked classes, the links that joined them, representatives, and sets of all linked ones."""
    small_batches(docs.sparkSession)
    docs = only(docs, "doc_id", "text").where("doc_id is not null")
    sets = saved(describe(docs, words, scheme), "described")
    one = sets.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "h1", "h2", "spare_even", "spare_odd")).alias("x")).select("doc_id", "x.*")
    facts = saved(classes(one, ["h1", "h2"], "doc_id"), "known")
    # One row for each class; equal rows of its smallest document have equal sketches and signatures.
    least = facts.where("doc_id = class_id and n_shingles > 0").select("doc_id", "h1", "h2")
    rep = sets.join(least, ["doc_id", "h1", "h2"], "left_semi").select("doc_id", "n_shingles", "h1", "sketch").dropDuplicates(["doc_id"])
    rep = saved(rep, "classes")

    # Round one: each class against the centre of its bucket.
    shared = index(docs, words, scheme, False)
    named = lambda c: rep.select("h1", F.col("doc_id").alias(c))
    star = shared.where("centre <> h1").select("centre", "h1").distinct()
    star = star.join(named("b"), "h1").drop("h1").withColumnRenamed("centre", "h1").join(named("a"), "h1").select("a", "b")
    found, elements = verify(close(star, rep, scheme), docs, least, words, scheme)
    parts = components(found)

    # Round two: what still lies in different components of a bucket.
    label = rep.select("doc_id", "h1").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "h1", F.coalesce("component", "doc_id").alias("component"))
    open_ = mixed_buckets(shared, label)
    crowded = open_.where(F.col("parts") > CROWD)
    odd = F.col("sig").bitwiseAND(1) == 1
    lost = crowded.groupBy("doc_id").agg(F.count_if(odd).alias("odd"), F.count_if(~odd).alias("even"))
    laden = saved(lost.join(facts, "doc_id").where("odd > spare_odd or even > spare_even").select("doc_id", "h1", "h2"), "laden")
    rows = open_.where(F.col("parts") <= CROWD).select("sig", "doc_id", "component")
    if not laden.isEmpty():
        rows = rows.unionByName(mixed_buckets(index(docs.join(laden, "doc_id"), words, scheme, True), label).select("sig", "doc_id", "component"))
    proposed = saved(proposals(rows.distinct(), rep, scheme), "proposed")
    if proposed.isEmpty():
        return facts, parts, found, rep, elements
    more, others = settle(proposed, label, rep, docs, least, words, scheme)
    if not more.isEmpty():
        found = found.unionByName(more)
        parts = components(found)
        elements = elements.unionByName(others.join(elements.select("doc_id"), "doc_id", "left_anti"))
    return facts, parts, found, rep, elements


def _named(facts: DataFrame, parts: DataFrame) -> DataFrame:
    out = facts.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id")


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (linked sets), class_id (equal sets) of every document, without the links within components."""
    facts, parts, *_ = _matched(docs, words, Scheme(percent))
    return _named(facts, parts)


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """As ``groups``, and n_links: how many other classes the document's class is linked to."""
    scheme = Scheme(percent)
    facts, parts, found, rep, sets = _matched(docs, words, scheme)
    degree = every_link(found, parts, rep, sets, scheme).groupBy("class_id").agg(F.sum(F.size("near")).alias("n_links"))
    return _named(facts, parts).join(degree, "class_id", "left").select("doc_id", "n_shingles", "component_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def links(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(a, b), a < b: all linked pairs of classes, each once."""
    scheme = Scheme(percent)
    _, parts, found, rep, sets = _matched(docs, words, scheme)
    return every_link(found, parts, rep, sets, scheme).select(F.col("class_id").alias("a"), F.explode("near").alias("b")).where("a < b")
