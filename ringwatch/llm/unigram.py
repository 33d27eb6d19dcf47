"""Best segmentation of texts into the pieces of a public SentencePiece vocabulary.

Scores come from the vocabulary's order by Zipf's law, as whole numbers (``-1024 ln(rank + 2)``), so that
sums are exact in any order. The best segmentation is a longest path, hence a product of matrices in the
(max, +) semiring: a text is cut into chunks, each gives the matrix of best scores
between the states at its two ends (how far a piece reaches over the boundary), matrices are combined by an
associative scan, and once the states at all boundaries are known every chunk finds its pieces on its own. Texts of up to
``CHUNK`` characters are one chunk. Within a chunk no piece crosses a blank after other characters or a line break, so the
stretches between such places are solved once for each distinct stretch of a task, before the states are known.

Decoding gives back the very text: characters outside the vocabulary are spelled in bytes, as is a
literal U+2581. Ties between segmentations go to the longer piece at the end, within a chunk.

Nulls: a null text is empty and has no ids; a null doc_id is kept. Repeated rows are coded each on its own. An empty table gives no rows. Very long
texts are chunked, and one task holds a small matrix for each chunk of a text. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import only, saved, small_batches
from ringwatch.llm.words import merged, strings, take_ranges, utf8

CHUNK = 1 << 13
#: Characters a chunk sees beyond its end: at least the longest piece.
REACH = 64
_NONE = -(1 << 50)
ENCODED = "doc_id long, n_chars long, n_tokens long, score long, text_crc32 long, decoded_crc32 long, ids array<int>"


#: Where no piece goes on: before a blank that follows another character, and before a line break.
_CUT = re.compile(r"(?<! ) |\n")


class Vocabulary:
    """Pieces with blanks as blanks, their scores, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.raw, self.byte = {}, {}, [], [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.ids[text], self.score[text] = i, -round(1024 * math.log(2 - sp.get_score(i)))
                self.raw.append(text.encode())
        self.unknown = min(self.score.values()) - 10
        self.longest = max(map(len, self.ids))
        self.trie: dict = {}
        for text, score in self.score.items():
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[""] = score
        if self.longest > REACH:
            raise ValueError("a piece is longer than what chunks see beyond their end")
        if any(" " in t.lstrip(" ") or "\n" in t for t in self.ids):
            raise ValueError("a piece crosses a blank or a line break")
        self.lengths = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def edges(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(length, score) of what may start at a place: pieces, or the one character unknown."""
        node, end = self.trie, at
        while end < len(text) and (node := node.get(text[end])) is not None:
            end += 1
            if "" in node:
                yield end - at, node[""]
        if text[at] not in self.score:
            yield 1, self.unknown

    def spell(self, part: str) -> list[int]:
        return [self.ids[part]] if part in self.ids else [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]

    def best(self, text: str, stop: int | None = None, first: int = 0, beyond: int = 0) -> tuple[int, list[int]]:
        """Best path from ``first`` to ``stop + beyond``, over pieces that start before ``stop``."""
        stop = len(text) if stop is None else stop
        if first >= stop:
            return (0, []) if first == stop + beyond else (_NONE, [])
        n = stop + beyond
        score, back = [_NONE] * (n + 1), [0] * (n + 1)
        score[first] = 0
        trie, unknown = self.trie, self.unknown
        for i in range(first, stop):
            base = score[i]
            if base == _NONE:
                continue
            node = trie.get(text[i])
            if node is None or "" not in node:
                if base + unknown > score[i + 1]:
                    score[i + 1], back[i + 1] = base + unknown, i
            end = i
            while node is not None:
                end += 1
                if "" in node and base + node[""] > score[end]:
                    score[end], back[end] = base + node[""], i
                if end == n:
                    break
                node = node.get(text[end])
        out, at = [], n
        while at > first:
            out.append(text[back[at] : at])
            at = back[at]
        return score[n], [i for part in reversed(out) for i in self.spell(part)]

    def cuts(self, text: str, size: int) -> tuple[int, int]:
        """First and last place of ``text[:size]``, from ``longest`` on, that no piece crosses and no state reaches over; ``size`` twice if there is none."""
        found = _CUT.search(text, self.longest, size)
        if found is None:
            return size, size
        line, last = text.rfind("\n", self.longest, size), text.rfind(" ", self.longest, size)
        while last > line and text[last - 1] == " ":
            last = text.rfind(" ", self.longest, last)
        return found.start(), max(last, line)

    def transfer(self, text: str, size: int, middle: int | None = None) -> np.ndarray:
        """Best scores from each state before the chunk ``text[:size]`` to each after it.

        ``text`` goes on for up to ``longest - 1`` characters, into which the last piece may reach. ``middle``: the score between the cuts, if known.
        """
        width = self.longest
        a, b = self.cuts(text, size)
        if a == size:
            score = np.full((size + width, width), _NONE, np.int64)
            for i in range(min(width, size + width)):
                score[i, i] = 0
            for i in range(size):
                if score[i].max() > _NONE:
                    for k, s in self.edges(text, i):
                        np.maximum(score[i + k], score[i] + s, out=score[i + k])
            return np.maximum(score[size : size + width].T, _NONE)
        # Every path meets at both cuts, so the matrix is a sum of the ways to the first, the way between them and the ways from the last.
        left, right = [0] * (a + 1), [0] + [_NONE] * (size - b + width)
        for i in range(a - 1, -1, -1):
            left[i] = max(s + left[i + k] for k, s in self.edges(text, i))
        for i in range(size - b):
            if right[i] > _NONE:
                for k, s in self.edges(text, b + i):
                    right[i + k] = max(right[i + k], right[i] + s)
        if middle is None:
            middle = self.units(text[a:b])[1]
        return np.maximum(np.array(left[:width])[:, None] + middle + np.array(right[size - b : size - b + width]), _NONE)

    def units(self, text: str) -> tuple[list[int], int]:
        """Ids and score of a stretch that begins and ends at cuts."""
        ids, total, cache = [], 0, {}
        starts = [0, *(i for i in range(1, len(text)) if text[i] == " " and text[i - 1] != " "), len(text)]
        for a, b in zip(starts, starts[1:], strict=False):
            part = text[a:b]
            if part not in cache:
                cache[part] = self.best(part)
            s, found = cache[part]
            total += s
            ids += found
        return ids, total

    def encode(self, texts: pa.Array, cache: dict, lead: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order, and for each text the number of ids and the score; ``lead``: a blank goes before each text."""
        raw, offsets = utf8(texts)
        some = (np.diff(offsets) > 0) & lead
        new = offsets + np.concatenate([[0], np.cumsum(some)])
        data = np.full(int(new[-1]), 0x20, np.uint8)
        fill = np.ones(len(data), bool)
        fill[new[:-1][some]] = False
        data[fill] = raw
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        start, blank, line = np.zeros(len(data), bool), data == 0x20, data == 0x0A
        start[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
        start[new[:-1][np.diff(new) > 0]] = True
        at = np.flatnonzero(start)
        units = strings(data, np.diff(np.append(at, len(data)))).dictionary_encode()
        values = units.dictionary.to_pylist()
        if len(cache) > 600_000:
            cache.clear()
        for v in values:
            if v not in cache:
                s, ids = self.best(v.decode("utf-8", "surrogatepass"))
                cache[v] = (np.array(ids, np.int32).tobytes(), s)
        coded = [cache[v] for v in values]
        lengths = np.fromiter((len(c[0]) for c in coded), np.int64, len(coded)) // 4
        index = units.indices.to_numpy()
        counts = lengths[index]
        ids = take_ranges(np.frombuffer(b"".join(c[0] for c in coded), np.int32), (np.cumsum(lengths) - lengths)[index], counts)
        place = np.searchsorted(at, new)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[place])
        return ids, sums(counts), sums(np.fromiter((c[1] for c in coded), np.int64, len(coded))[index])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of consecutive runs of ids."""
        counts_raw = self.lengths[ids]
        flat = take_ranges(self.flat, (np.cumsum(self.lengths) - self.lengths)[ids], counts_raw).tobytes()
        upto = np.concatenate([[0], np.cumsum(counts_raw)])
        ends = np.cumsum(counts)
        return [flat[a + 1 : b] if b > a else b"" for a, b in zip(upto[ends - counts].tolist(), upto[ends].tolist(), strict=True)]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, read once a process."""
    return Vocabulary(path)


def _packing(words: Vocabulary) -> np.dtype:
    """What an id is stored in between steps."""
    return np.dtype(np.uint16 if len(words.raw) <= 1 << 16 else np.int32)


def _rows(doc: pa.Array, n_chars: pa.Array, text_crc32: pa.Array, ids: np.ndarray, counts: np.ndarray, score: np.ndarray, decoded: list[bytes]) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    columns = {
        "doc_id": doc.cast(pa.int64()),
        "n_chars": n_chars,
        "n_tokens": pa.array(counts, pa.int64()),
        "score": pa.array(score, pa.int64()),
        "text_crc32": text_crc32,
        "decoded_crc32": pa.array([zlib.crc32(d) for d in decoded], pa.int64()),
        "ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
    }
    return pa.RecordBatch.from_pydict(columns)


def _facts(texts: list[str]) -> list[pa.Array]:
    """Code points and checksum of each text."""
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())]


def _short(docs: DataFrame, path: str) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cache = vocabulary(path), {}
        for batch in merged(batches, "text"):
            ids, counts, score = words.encode(batch.column("text"), cache)
            yield _rows(batch.column("doc_id"), *_facts([t or "" for t in batch.column("text").to_pylist()]), ids, counts, score, words.decode(ids, counts))

    return docs.mapInArrow(code, ENCODED)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of matrices in the (max, +) semiring."""
    return np.maximum(reduce(np.maximum, (a[:, :, k, None] + b[:, k, None, :] for k in range(a.shape[2]))), _NONE)


def boundary_states(matrices: np.ndarray) -> np.ndarray:
    """States at all boundaries of the best path through the chunks, from 0 to 0."""
    scan, step = matrices.copy(), 1
    while step < len(scan):
        scan[step:] = combine(scan[:-step], scan[step:])
        step *= 2
    states = np.zeros(len(matrices) + 1, np.int64)
    for k in range(len(matrices) - 1, 0, -1):
        states[k] = int((scan[k - 1][0] + matrices[k][:, states[k + 1]]).argmax())
    return states


def _long(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """Texts are dealt out as chunks. What lies between a chunk's cuts is the same whatever its states are, so it is coded at once, and only ids, the matrix and the two
    ends go on to where a text's states are found. What else is said of a text goes with its first chunk, and rows have numbers of their own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                whole, facts = " " + text, _facts([text])
                for k in range(0, len(whole), chunk):
                    told = [pa.array([doc], pa.int64()), *facts] if k == 0 else [pa.nulls(1, pa.int64())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k // chunk], pa.int32()), *told, pa.array([whole[k : k + chunk + REACH]])], names=["row", "k", "doc_id", "n_chars", "text_crc32", "part"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cache = vocabulary(path), {}
        for batch in merged(batches, "part"):
            parts = [p[: chunk + words.longest - 1] for p in batch.column("part").to_pylist()]
            sizes = [min(chunk, len(p)) for p in parts]
            cuts = [words.cuts(p, n) for p, n in zip(parts, sizes, strict=True)]
            ids, counts, score = words.encode(pa.array([p[a:b] for p, (a, b) in zip(parts, cuts, strict=True)], pa.string()), cache, lead=False)
            found = [words.transfer(p, n, m).tobytes() for p, n, m in zip(parts, sizes, score.tolist(), strict=True)]
            # Without a cut the whole chunk is its tail.
            inner = [a < n for n, (a, _) in zip(sizes, cuts, strict=True)]
            heads = [p[:a] if x else None for p, (a, _), x in zip(parts, cuts, inner, strict=True)]
            tails = [p[b:] if x else p for p, (_, b), x in zip(parts, cuts, inner, strict=True)]
            stops = [n - b if x else n for n, (_, b), x in zip(sizes, cuts, inner, strict=True)]
            packed = strings(ids.astype(_packing(words)).view(np.uint8), counts * _packing(words).itemsize).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in told), pa.array(found, pa.binary()), pa.array(heads, pa.string()), packed, pa.array(tails, pa.string()), pa.array(stops, pa.int32())], names=[*told, "matrix", "head", "ids", "tail", "stop"])

    def join(rows: pa.Table) -> pa.Table:
        words, rows = vocabulary(path), rows.sort_by("k")
        matrices = np.stack([np.frombuffer(m, np.int64).reshape(words.longest, words.longest) for m in rows["matrix"].to_pylist()])
        states = boundary_states(matrices)
        score, ids = int(matrices[np.arange(len(matrices)), states[:-1], states[1:]].sum()), []
        for enter, leave, head, inner, tail, stop in zip(states[:-1].tolist(), states[1:].tolist(), *(rows[c].to_pylist() for c in ("head", "ids", "tail", "stop")), strict=True):
            if head is not None:
                ids += [np.array(words.best(head, None, enter)[1], np.int32), np.frombuffer(inner, _packing(words)).astype(np.int32)]
            ids.append(np.array(words.best(tail, stop, enter if head is None else 0, leave)[1], np.int32))
        ids = np.concatenate(ids)
        counts, first = np.array([len(ids)]), rows.slice(0, 1).combine_chunks()
        return pa.Table.from_batches([_rows(*(first[c].combine_chunks() for c in told[2:]), ids, counts, np.array([score]), words.decode(ids, counts))])

    told = ["row", "k", "doc_id", "n_chars", "text_crc32"]
    facts = "row long, k int, doc_id long, n_chars long, text_crc32 long"
    chunks = saved(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, f"{facts}, part string").repartition("row", "k"), "chunks")
    coded = chunks.mapInArrow(code, f"{facts}, matrix binary, head string, ids binary, tail string, stop int")
    # A text's ids meet in one group, since its row holds them all; with them a small matrix for each chunk.
    return coded.groupBy("row").applyInArrow(join, ENCODED)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Ids of every text, their score, and checksums of the text and of the decoded ids."""
    small_batches(docs.sparkSession)
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.length(F.coalesce("text", F.lit(""))) >= chunk
    return _short(docs.where(~long), path).unionByName(_long(docs.where(long), path, chunk))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            lists = batch.column("ids")
            texts = words.decode(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode("utf-8", "surrogatepass") for t in texts])], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(back, "doc_id long, text string")
