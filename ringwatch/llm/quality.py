"""Co-trained quality classifier: the text and the page's metadata as two views.

Each view weighs evidence by counts: a word of the text (or a value of the metadata) speaks for good by the log ratio of how many good and
poor documents have it. A logistic classifier of the view puts this together with the view's measures: shapes of characters and words for the
text, the length for the page. The counts start from labelled documents. In each round every unlabelled document that one view is sure of goes
into the other view's counts, with less weight. Labelled documents have three roles, by a hash of the id: two fifths are counted, two fifths fit
the logistic classifiers, and one fifth calibrates each view (Platt scaling) and sets the threshold of the combined score, which adds the views'
evidence to the prior log odds. The threshold is the highest at which at most ``LOST`` of the good documents kept apart would be rejected. Where a
role would lack good or poor documents, all labelled ones have all roles.

Counts cover all labelled documents of their role and all unlabelled ones, summed on Spark; the driver sees ``BUCKETS`` counts a view, since words
and values are hashed to that many. The logistic classifiers take at most ``LABELLED`` labelled documents, those with the least hashes of their
ids: a bounded sample, of whose measures alone some kilobytes a document reach the driver. Scoring covers all documents.

Nulls: a null text is empty, a null language, source or length is a value of its own; labels whose quality or id is null are unused, and of
labels with one id the least quality counts. Repeated rows are counted and scored alike, and so are ties; of rows with one id the least fits the classifiers. A very
long text is counted and scored whole, each word once. An empty table gives no rows. Without labels of both kinds every document scores the prior
(1.0 without any label) and is accepted. Extra columns are ignored. ``doc_id``, ``text``, ``lang``, ``source`` and ``n_chars`` are needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import saved, small_batches
from ringwatch.llm.words import hashed, merged, split_words, utf8

LABELLED, ROUNDS, SURE, LOST = 20_000, 3, 0.98, 0.002
#: Places of hashed words and values; weights of a labelled and of a pseudo-labelled document; smoothing of counts.
BUCKETS, TOLD, GUESSED, SMOOTH = 1 << 16, 10, 3, 20.0
#: Byte classes: lower, upper, digit, line break, other space, each of some marks, other ASCII, beyond.
_MARKS = b"!|*#&$%@.,?;:-_=<>\"'()"
_CLASS = np.full(256, 5 + len(_MARKS), np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[10], _CLASS[[9, 13, 32]] = 0, 1, 2, 3, 4
_CLASS[list(_MARKS)] = np.arange(5, 5 + len(_MARKS))
_CLASS[128:] = 6 + len(_MARKS)
_N_CLASS = 7 + len(_MARKS)


class Measures(NamedTuple):
    """What is kept of a batch of documents: distinct words and page values (hashed), and numbers of both views."""

    words: pa.ListArray
    page: np.ndarray
    text_x: np.ndarray
    page_x: np.ndarray


def text_view(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Places of each text's distinct words; shares of byte classes, how varied and how long its words are."""
    raw, offsets = utf8(texts)
    n = len(texts)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    share = np.bincount(row * _N_CLASS + _CLASS[raw], minlength=n * _N_CLASS).reshape(n, _N_CLASS) / np.maximum(size, 1)[:, None]
    index, words, counts = split_words(texts, lower=False)
    at = np.repeat(np.arange(n, dtype=np.int64), counts)
    pair = np.unique(at * max(1, len(words)) + index)
    kinds = np.bincount(pair // max(1, len(words)), minlength=n)
    length = np.fromiter((len(w) for w in words.to_pylist()), float, len(words))[index] if len(index) else np.zeros(0)
    some = np.maximum(counts, 1)
    mean = np.bincount(at, length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(at, length**2, minlength=n) / some - mean**2, 0))
    more = np.column_stack([kinds / some, np.log1p(counts), mean, spread, kinds / np.sqrt(some)])
    place = (hashed(words) % np.uint64(BUCKETS)).astype(np.int64)
    # Two words in one place are one.
    found = np.unique(pair // max(1, len(words)) * BUCKETS + place[pair % max(1, len(words))]) if len(pair) else pair
    ends = np.append(0, np.cumsum(np.bincount(found // BUCKETS, minlength=n)))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found % BUCKETS, pa.int32()))
    return lists, np.column_stack([np.sqrt(share), share, more, size == 0])


def page_view(langs: list, sources: list, chars: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of each page's language, source and order of length; its length in numbers."""
    size = np.log1p(np.array([max(c or 0, 0) for c in chars], float))
    order = [None if c is None else int(x * 2) for c, x in zip(chars, size, strict=True)]
    places = [[zlib.crc32(repr(pair).encode()) % BUCKETS for pair in zip(("lang", "source", "size"), row, strict=True)] for row in zip(langs, sources, order, strict=True)]
    return np.array(places, np.int64).reshape(-1, 3), np.column_stack([size / 10, (size / 10) ** 2, size < np.log1p(100)])


def measured(batch: pa.RecordBatch) -> Measures:
    words, text_x = text_view(batch.column("text"))
    page, page_x = page_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
    return Measures(words, page, text_x.astype(np.float32), page_x.astype(np.float32))


def _numbers(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1)


def _packed(words: pa.ListArray) -> pa.Array:
    """Lists of places as bytes, two a place."""
    ends, places = words.offsets.to_numpy() * 2, words.values.to_numpy().astype("<u2")
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(places)])


def _unpacked(packed: pa.Array) -> pa.ListArray:
    sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False) // 2
    places = np.frombuffer(b"".join(packed.to_pylist()), "<u2").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(places))


def stored(batch: pa.RecordBatch) -> Measures:
    """The measures of a batch as ``tokens`` keeps them."""
    page = batch.column("page").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
    return Measures(_unpacked(batch.column("words")), page, *(_numbers(batch.column(c).to_pylist()) for c in ("text_x", "page_x")))


def weights(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """Log ratio of each place's good and bad counts, less that of all documents; none for a place never seen."""
    share = (n_good + 1) / (n_good + n_bad + 2)
    return np.clip(np.log((good + SMOOTH * share) / (bad + SMOOTH * (1 - share))) - np.log(share / (1 - share)), -6, 6).astype(np.float32)


def evidence(m: Measures, by_word: np.ndarray, by_value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logistic classifiers' input: what a view's counts say, beside its measures."""
    n = len(m.page)
    counts = np.asarray(m.words.value_lengths()).astype(np.int64)
    w = by_word[m.words.flatten().to_numpy(zero_copy_only=False)].astype(float)
    at, some = np.repeat(np.arange(n), counts), np.maximum(counts, 1)
    total, against = np.bincount(at, w, minlength=n), np.bincount(at, np.minimum(w, 0), minlength=n)
    return np.column_stack([total / some, total / np.sqrt(some), against / some, m.text_x]), np.column_stack([by_value[m.page], m.page_x])


class Logistic:
    """Ridge logistic regression on standardized features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3.0):
        parts = range(0, len(x), 2048)
        self.mean = sum(x[a : a + 2048].sum(axis=0, dtype=float) for a in parts) / max(1, len(x))
        square = sum(((x[a : a + 2048] - self.mean) ** 2).sum(axis=0) for a in parts) / max(1, len(x))
        self.scale = np.maximum(np.sqrt(square), 1e-3)
        width = x.shape[1] + 1
        self.w = np.zeros(width)
        penalty = np.full(width, ridge)
        penalty[-1] = 1e-3
        for _ in range(25):
            g, h = -penalty * self.w, np.diag(penalty)
            for a in range(0, len(x), 2048):  # never the whole standardized matrix
                z, part = self._z(x[a : a + 2048]), slice(a, a + 2048)
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                g += z.T @ (weight[part] * (y[part] - p))
                h += (z * (weight[part] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
            step = np.linalg.solve(h, g)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        return np.concatenate([self._z(x[a : a + 2048]) @ self.w for a in range(0, len(x), 2048)]) if len(x) else np.zeros(0)


class Views:
    """Two views fitted to their counts, their calibration and the threshold of the combined score."""

    def __init__(self, by_word: np.ndarray, by_value: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, fits: np.ndarray, held: np.ndarray):
        self.by_word, self.by_value = by_word, by_value
        self.prior = float(np.log((y == 1).sum() / (y == 0).sum()))
        self.a, self.b = (Logistic(x[fits], y[fits], np.ones(int(fits.sum()))) for x in (a, b))
        self.platt = [Logistic(model.odds(x[held])[:, None], y[held], np.ones(int(held.sum())), ridge=0.1) for model, x in ((self.a, a), (self.b, b))]
        good = np.sort(self._score(a[held], b[held])[2][y[held] == 1])
        self.threshold = float(min(0.5, good[int(len(good) * LOST)]))

    def _score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = self.platt[0].odds(self.a.odds(a)[:, None]), self.platt[1].odds(self.b.odds(b)[:, None])
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return sigmoid(x), sigmoid(y), sigmoid(x + y - self.prior)

    def score(self, m: Measures) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good by text, by metadata and by both."""
        return self._score(*evidence(m, self.by_word, self.by_value))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, words, page, text_x, page_x) of every row; the words' places packed, since all rows are shuffled once to their labels."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text"):
            m = measured(batch)
            numbers = [pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()) for x in (m.text_x, m.page_x)]
            page = pa.array(m.page.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), _packed(m.words), page, *numbers], names=["doc_id", "words", "page", "text_x", "page_x"])

    return _plain(docs).mapInArrow(extract, "doc_id long, words binary, page array<int>, text_x binary, page_x binary")


def told(rows: DataFrame, views: Views | None) -> DataFrame:
    """(view, place, good, bad): weighted counts of documents with each word or value; place -1 counts all.

    Labelled rows count for both views where ``counts`` holds. Of unlabelled ones, each view tells the other those it is sure of.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, BUCKETS + 1), np.int64)  # view, good or bad, place (the last for all)
        for batch in batches:
            if not batch.num_rows:
                continue
            m, y = stored(batch), batch.column("y").cast(pa.float64()).to_numpy(zero_copy_only=False)
            known = batch.column("counts").to_numpy(zero_copy_only=False).astype(bool)
            said = np.full((2, len(y)), -1)
            said[:, known] = y[known]
            if views is not None:
                p, q, _ = views.score(m)
                for view, other in ((0, q), (1, p)):
                    said[view, np.isnan(y) & (other >= SURE)] = 1
                    said[view, np.isnan(y) & (other <= 1 - SURE)] = 0
            weight = np.where(known, TOLD, GUESSED)
            lengths = np.asarray(m.words.value_lengths()).astype(np.int64)
            places = (m.words.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(y)), lengths)), (m.page.ravel(), np.repeat(np.arange(len(y)), 3))
            for view, (place, row) in enumerate(places):
                for kind in (0, 1):
                    one = np.where(said[view] == kind, weight, 0)
                    sums[view, kind, :-1] += np.bincount(place, one[row], minlength=BUCKETS).astype(np.int64)
                    sums[view, kind, -1] += one.sum()
        view, place = np.nonzero(sums.any(axis=1))
        columns = [view, np.where(place == BUCKETS, -1, place), sums[view, 1, place], sums[view, 0, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["view", "place", "good", "bad"])

    parts = rows.mapInArrow(count, "view int, place int, good long, bad long")
    return parts.groupBy("view", "place").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Views | None, DataFrame | None]:
    """The views and the measures of all rows, or nothing without labels of both kinds."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") >= 1).cast("int")).alias("y"))
    role = F.element_at(F.array(*map(F.lit, (0, 0, 1, 1, 2))), (F.pmod(F.xxhash64(F.lit("role"), F.col("doc_id")), F.lit(5)) + 1).cast("int"))
    known = docs.select("doc_id").distinct().join(known, "doc_id").withColumn("role", role)
    # At most six rows.
    kinds = {(r["role"], r["y"]) for r in known.select("role", "y").distinct().collect()}
    if {y for _, y in kinds} != {0, 1}:
        return None, None
    every = len(kinds) < 6
    known = saved(known, "labels")
    # Labels grow with the documents, so they are never broadcast: one plan at every size.
    told_of = known.select("doc_id", "y", (F.lit(every) | (F.col("role") == 0)).alias("counts")).hint("merge")
    rows = saved(tokens(docs).join(told_of, "doc_id", "left").withColumn("counts", F.coalesce("counts", F.lit(False))), "tokens")
    # At most LABELLED ids.
    chosen = known.where(F.lit(every) | (F.col("role") > 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).select("doc_id", "role")
    least = F.min(F.struct("words", "page", "text_x", "page_x", "y", "role"))
    sample = saved(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(least.alias("least")).select("doc_id", "least.*"), "sample")

    def fitted(counts: pa.Table) -> Views:
        by = []
        for view in (0, 1):
            part = counts.filter(pc.equal(counts["view"], view))
            place, sums = part["place"].to_numpy(), np.zeros((2, BUCKETS + 1))
            sums[0][place], sums[1][place] = part["good"].to_numpy(), part["bad"].to_numpy()  # place -1 is the last
            by.append(weights(sums[0][:-1], sums[1][:-1], sums[0][-1], sums[1][-1]))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = [pa.array([r.astype("<f4").tobytes() for r in e], pa.binary()) for e in evidence(stored(batch), *by)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("role"), *x], names=["doc_id", "y", "role", "a", "b"])

        # Some 70 numbers a document.
        got = sample.mapInArrow(weigh, "doc_id long, y int, role int, a binary, b binary").toArrow().sort_by("doc_id")
        y, at = got["y"].to_numpy(), got["role"].to_numpy()
        fits, held = (np.ones(len(y), bool),) * 2 if every else (at == 1, at == 2)
        return Views(*by, *(_numbers(got[c].to_pylist()) for c in ("a", "b")), y, fits, held)

    views = None
    for _ in range(ROUNDS + 1):
        views = fitted(told(rows, views).toArrow())
    return views, rows


def _judge(views: Views | None, labels: DataFrame):
    """A function from measures to p_text, p_page, score and accepted."""
    share = None if views else labels.agg(F.avg("quality")).first()[0]
    prior = 1.0 if share is None else float(share)

    def judge(m: Measures) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if views is None:
            p = np.full(len(m.page), prior)
            return p, p, p, np.ones(len(p), bool)
        p, q, s = views.score(m)
        return p, q, s, s >= views.threshold

    return judge


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_text, p_page, score and accepted for every row of ``docs``."""
    small_batches(docs.sparkSession)
    views, rows = train(docs, labels)
    judge = _judge(views, labels)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, judge(stored(batch)))], names=["doc_id", "p_text", "p_page", "score", "accepted"])

    return (tokens(docs) if rows is None else rows).mapInArrow(rate, "doc_id long, p_text double, p_page double, score double, accepted boolean")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    small_batches(docs.sparkSession)
    judge = _judge(train(docs, labels)[0], labels)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text"):
            yield batch.filter(pa.array(judge(measured(batch))[3]))

    return docs.mapInArrow(accept, docs.schema)
