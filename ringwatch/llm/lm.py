"""Hierarchical Pitman-Yor language model of word tokens, for scoring texts.

The context of a token is the word before it in its document (or the document's start). Each context is a restaurant of its own;
they share one parent, the restaurant without context, whose base is uniform over the
distinct training tokens and one unknown. Contexts are hashed to ``CONTEXTS`` restaurants, so that what every task must know of all
of them is a vector of fixed length; with more distinct words than that, some share one. Customers of a context restaurant are the training tokens;
each of its tables sends one customer to the parent. Seatings are sampled by blocked Gibbs sweeps: the tables of a dish in a
restaurant are drawn anew given the tables of all other dishes (whose numbers are those of the
sweep before), and predictive probabilities are averaged over the sweeps after the burn-in. Every sweep's
probabilities sum to one, since it is used with its own number of tables. The log10 probability of a text is the
sum over its lower-cased words and one end token (single precision each, added in double); all unknown words are one outcome. Random numbers are hashes of the word, the context
and the sweep, so scores do not depend on how the documents are partitioned.

Documents are read in blocks. A block sends each (word, context) it holds, with its training count, to the part
of the word's hash once, however often it occurs, and keeps the places. A sweep is a pass over the
parts that seats their cells and adds up tables. Then each part answers every block with the probabilities it asked for, in order,
and the block adds them up for its documents. No word's places ever meet in one task. The number of parts follows the
size of the texts. Only the sweeps' totals (``CONTEXTS`` numbers) reach the driver. Counts cover all training documents; words are
told apart by 64-bit hashes.

Nulls: a null text is empty; rows with a null doc_id are left out. Repeated rows are documents of
their own. A very long text is part of one block, whose task holds it whole. Ties cannot arise: no order is involved. An empty table gives
no rows; without training documents every token is unknown. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import only, saved, small_batches
from ringwatch.llm.words import hashed, merged, mixed, split_words

_U = np.uint64
CONTEXTS = 1 << 16
DISCOUNT, STRENGTH = 0.75, 2.0  # of the context restaurants
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 1.0
SWEEPS, BURN_IN = 3, 1
#: Bytes of text for each part of the words.
PART = 8 << 20
#: Bytes of text in a block: the larger, the more often a (word, context) recurs in it.
BLOCK = 6 << 20
_GOLDEN, _START, _SLICES = _U(0x9E3779B97F4A7C15), 0x5851F42D4C957F2D, 16


def is_training(doc: np.ndarray) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"%d" % d) % 5 != 1 for d in doc.tolist()), bool, len(doc))


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed string; their first bytes together, then their second ones, and so on."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    raw = len(head).to_bytes(4, "little") + head + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _arrays(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word indices with the end token after each text, the dictionary (end last), document rows."""
    index, words, counts = split_words(batch.column("text"))
    n = len(counts)
    rows = np.repeat(np.arange(n), counts)
    words = pa.concat_arrays([words, pa.array([b""], pa.large_binary())])
    return np.append(index, np.full(n, len(words) - 1)), words, np.append(rows, np.arange(n))


def _block(batch: pa.RecordBatch, parts: int) -> list[tuple[int, bytes]]:
    """What a block sends to each part, and its places under part -1. The arrays end with the call."""
    index, words, rows = _tokens(batch)
    order = np.argsort(rows, kind="stable")
    index, rows = index[order].astype(np.int64), rows[order].astype(np.int32)
    del order
    name = hashed(words)
    place = ((name >> _U(24)) % _U(CONTEXTS)).astype(np.int64)
    before = np.append(_START % CONTEXTS, place[index[:-1]])
    before[np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))] = _START % CONTEXTS
    doc = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    index *= CONTEXTS
    index += before
    del before
    cells, cell = np.unique(index, return_inverse=True)
    del index
    train = np.bincount(cell, is_training(doc)[rows]).astype(np.uint32)
    word, context = cells // CONTEXTS, (cells % CONTEXTS).astype(np.uint32)
    part_of = (name % _U(parts)).astype(np.int64)
    by_word, by_cell = np.argsort(part_of, kind="stable"), np.argsort(part_of[word], kind="stable")
    where = np.empty(len(cells), np.uint32)
    where[by_cell] = np.arange(len(cells))
    a, b = (np.searchsorted(p, np.arange(parts + 1)) for p in (part_of[by_word], part_of[word[by_cell]]))
    new, out = np.empty(len(name), np.uint32), [(-1, _blob(doc, np.bincount(rows, minlength=len(doc)).astype(np.uint32), where[cell]))]
    for p in np.unique(part_of).tolist():
        own, cut = by_word[a[p] : a[p + 1]], by_cell[b[p] : b[p + 1]]
        new[own] = np.arange(len(own))
        out.append((p, _blob(name[own], new[word[cut]], context[cut], train[cut])))
    return out


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """(block, part, data): each part's words and cells of a block; its places under part -1.

    A cell is a (word, context) of a block. Cells are numbered by part, then word, then context.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, batch in enumerate(merged(batches, "text", BLOCK)):
            out = _block(batch, parts)
            columns = [pa.array([(task << 24) + number] * len(out), pa.int64()), pa.array([p for p, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())]
            del batch, out
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "data"])
            del columns

    return saved(docs.mapInArrow(split, "block long, part int, data binary"), "blocks")


def _by(batches: Iterator[pa.RecordBatch], key: str, *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with equal keys, of batches that are sorted by it."""
    now, held = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *columns)), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(tuple(row))
    if held:
        yield now, held


def _gathered(rows: list[tuple]) -> tuple[bytes, bytes]:
    """A part's words and training cells, and what each (block, data) asks for. The arrays end with the call."""
    names, word, context, train, sizes, at = [], [], [], [], [], 0
    for _, data in rows:
        name, w, g, k = _arrays(data)
        names.append(name)
        word.append(w.astype(np.int64) + at)
        context.append(g)
        train.append(k)
        sizes.append(len(w))
        at += len(name)
    name, index = np.unique(np.concatenate(names), return_inverse=True)
    del names
    key = index[np.concatenate(word)] * CONTEXTS + np.concatenate(context)
    del word, context, index
    train = np.concatenate(train)
    cells, at = np.unique(key[train > 0], return_inverse=True)
    c = np.bincount(at, train[train > 0], minlength=len(cells)).astype(np.int64)
    del train, at
    own = _blob(name, (cells // CONTEXTS).astype(np.uint32), (cells % CONTEXTS).astype(np.uint32), c)
    cell = np.searchsorted(cells, key)
    cell[np.append(cells, -1)[cell] != key] = -1
    other = key[cell < 0]  # cells without training tokens
    return own, _blob(np.array([b for b, _ in rows]), np.array(sizes), cell.astype(np.int32), (other // CONTEXTS).astype(np.uint32), (other % CONTEXTS).astype(np.uint32))


def gathered(sent: DataFrame, parts: int) -> DataFrame:
    """(part, cells, asked): a part's words and training cells, and the cells each block asks for."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by(batches, "part", "block", "data"):
            own, asked = _gathered(rows)
            rows.clear()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own], pa.binary()), pa.array([asked], pa.binary())], names=["part", "cells", "asked"])

    ordered = sent.where("part >= 0").repartition(parts, "part").sortWithinPartitions("part", "block")
    return saved(ordered.mapInArrow(gather, "part int, cells binary, asked binary"), "parts")


def uniform(key: np.ndarray, n: int) -> np.ndarray:
    """The n-th number in (0, 1) of each key."""
    with np.errstate(over="ignore"):
        return ((mixed(key + _U(n) * _GOLDEN) >> _U(12)) + 0.5) * 2.0**-52


def _poisson(mean: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Poisson counts by inversion; by the normal limit from a mean of 30 on."""
    out = np.zeros(len(mean))
    low = np.flatnonzero(mean < 30)
    term = np.exp(-mean[low])
    upto, k = term.copy(), 0
    while (more := u[low] > upto).any() and k < 200:
        k += 1
        out[low[more]] += 1
        term = term * mean[low] / k
        upto = upto + term
    high = np.flatnonzero(mean >= 30)
    normal = np.sqrt(-2 * np.log(u[high])) * np.cos(2 * np.pi * v[high])
    out[high] = np.maximum(0, np.rint(mean[high] + np.sqrt(mean[high]) * normal))
    return out


def drawn(c: np.ndarray, fresh: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``c`` customers; ``fresh`` weighs a new table, a customer at one discounts.

    The first 32 customers are seated one by one; later ones in steps of a tenth of those seated, within which the
    number of tables that weighs in is that of the step's start.
    """
    t = (c > 0).astype(float)
    at = np.flatnonzero(c > 1)
    for n in range(1, 32):
        t[at] += uniform(key[at], n) * (n - discount * t[at] + fresh[at]) < fresh[at]
        at = at[c[at] > n + 1]
    seated = np.full(len(at), 32.0)
    for n in range(1000):
        if not len(at):
            break
        then = np.minimum(c[at], np.ceil(seated * 1.1))
        rest = fresh[at] - discount * t[at]
        more = _poisson(fresh[at] * np.log((then + rest) / (seated + rest)), uniform(key[at], 40 + 2 * n), uniform(key[at], 41 + 2 * n))
        t[at] += np.minimum(more, then - seated)
        go = then < c[at]
        at, seated = at[go], then[go]
    return t


class Part:
    """Words and training cells of one part, and a seating of them."""

    def __init__(self, cells: bytes, known: int, customers: np.ndarray):
        self.name, word, context, self.c = _arrays(cells)
        self.word, self.context, self.known, self.customers = word.astype(np.int64), context.astype(np.int64), known, customers
        self.seat(np.ones(len(self.c)), None)

    def seat(self, t: np.ndarray, root: np.ndarray | None) -> Part:
        self.t, self.up = t, np.bincount(self.word, t, minlength=len(self.name))
        self.root = (self.up > 0).astype(float) if root is None else root
        return self

    def totals(self) -> np.ndarray:
        """Tables of every context and of the root."""
        return np.append(np.bincount(self.context, self.t, minlength=CONTEXTS), self.root.sum())

    def parent(self, total: np.ndarray) -> np.ndarray:
        """Probability of every word of the part in the root."""
        return (self.up - ROOT_DISCOUNT * self.root + (ROOT_STRENGTH + ROOT_DISCOUNT * total[-1]) / (self.known + 1)) / (ROOT_STRENGTH + total[:-1].sum())

    def step(self, total: np.ndarray, sweep: int) -> Part:
        """One sweep, given the totals of the one before."""
        above = self.parent(total)[self.word]
        with np.errstate(over="ignore"):
            name = mixed(self.name + _U(sweep) * _GOLDEN)
            cell = mixed(name[self.word] + self.context.astype(_U) + _U(1))
        t = drawn(self.c, (STRENGTH + DISCOUNT * total[self.context]) * above, DISCOUNT, cell)
        up = np.bincount(self.word, t, minlength=len(self.name))
        return self.seat(t, drawn(up, np.full(len(up), (ROOT_STRENGTH + ROOT_DISCOUNT * total[-1]) / (self.known + 1)), ROOT_DISCOUNT, name))

    def chances(self, total: np.ndarray, word: np.ndarray, context: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Probabilities of words in contexts; ``cell`` is the training cell, or -1."""
        p = (STRENGTH + DISCOUNT * total[context]) * self.parent(total)[word] + np.append(self.c - DISCOUNT * self.t, 0.0)[cell]
        return p / (STRENGTH + self.customers[context])


def _summed(parts: DataFrame, vector: Callable[[bytes], np.ndarray], width: int) -> np.ndarray:
    """Sum of the vectors of all parts' cells: within tasks, then slice by slice.

    Vectors are made where they are added, in one Python process a task: a second would keep its memory for all later stages.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                total += vector(cells)
        parts = [(i, _blob(x)) for i, x in enumerate(np.array_split(total, _SLICES)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["slice", "x"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column("slice").to_pylist(), batch.column("x").to_pylist(), strict=True):
                held[i] = held.get(i, 0.0) + _arrays(x)[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([_blob(x) for x in held.values()], pa.binary())], names=["slice", "x"])

    schema, out = "slice int, x binary", np.array_split(np.zeros(width), _SLICES)
    for r in parts.select("cells").mapInArrow(within, schema).repartition(_SLICES, "slice").mapInArrow(across, schema).collect():
        out[r["slice"]] = _arrays(bytes(r["x"]))[0]
    return np.concatenate(out)


def score(docs: DataFrame, part: int = PART) -> DataFrame:
    """base_score and score of every document (see the module)."""
    small_batches(docs.sparkSession)
    docs = only(docs, "doc_id", "text").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(12, size // part)
    sent = blocks(docs, n_parts)
    parts = gathered(sent, n_parts)

    def counted(cells: bytes) -> np.ndarray:
        _, word, context, c = _arrays(cells)
        return np.append(np.bincount(context, c, minlength=CONTEXTS), len(np.unique(word)))

    counts = _summed(parts, counted, CONTEXTS + 1)
    customers, known = counts[:-1], int(counts[-1])
    n_all = int(customers.sum())

    history: list[np.ndarray] = []  # totals of the sweeps so far; a seating follows from them and is not kept

    def swept(cells: bytes) -> np.ndarray:
        own = Part(cells, known, customers)
        for sweep, total in enumerate(history):
            own.step(total, sweep + 1)
        return own.totals()

    for _ in range(SWEEPS + 1):
        history.append(_summed(parts, swept, CONTEXTS + 1))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, cells, asked in zip(*(batch.column(c).to_pylist() for c in ("part", "cells", "asked")), strict=True):
                own = Part(cells, known, customers)
                c = np.bincount(own.word, own.c, minlength=len(own.name)).astype(np.int64)
                c = c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c
                block, sizes, cell, *other = _arrays(asked)
                word, context = (np.append(x, 0)[cell] for x in (own.word, own.context))
                word[cell < 0], context[cell < 0] = other
                mean = np.zeros(len(word))
                for sweep, total in enumerate(history[:-1], 1):
                    own.step(total, sweep)
                    if sweep > BURN_IN:
                        mean += own.chances(history[sweep], word, context, cell)
                log = np.log10(mean / (SWEEPS - BURN_IN)).astype(np.float32)
                ends = np.cumsum(sizes)
                for a in range(0, len(block), 64):
                    runs = [(int(block[i]), slice(ends[i] - sizes[i], ends[i])) for i in range(a, min(a + 64, len(block)))]
                    data = [_blob(c[word[r]], log[r]) for _, r in runs]
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in runs], pa.int64()), pa.array([number] * len(runs), pa.int32()), pa.array(data, pa.binary())], names=["block", "part", "data"])

    def texts(rows: list[tuple]) -> pa.RecordBatch:
        """A block's documents, from its places (part -1, which comes first) and the answers of all parts."""
        doc, n, cell = _arrays(rows[0][1])
        c, own = (np.concatenate(x) for x in zip(*(_arrays(d) for _, d in rows[1:]), strict=True))
        row = np.repeat(np.arange(len(doc), dtype=np.int32), n)
        add = lambda x: np.bincount(row, x[cell], minlength=len(doc))
        base = np.log10((c + 0.5) / (n_all + 0.5 * (known + 1)))
        columns = [doc, n.astype(np.int64), add(c > 0).astype(np.int64), add(base), add(own)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by(batches, "block", "part", "data"):
            yield texts(rows)

    answers = parts.mapInArrow(answer, "block long, part int, data binary").unionByName(sent.where("part < 0"))
    met = answers.repartition(n_parts, "block").sortWithinPartitions("block", "part")
    out = met.mapInArrow(added, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
