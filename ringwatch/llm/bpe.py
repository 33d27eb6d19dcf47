"""Byte-level BPE ids of whole texts with the tokenizers library.

BPE merges never cross the pre-tokenizer's pieces, so each distinct piece is encoded once and
the ids of a text are those of its pieces in order. Pieces are found for a whole batch at a
time from character classes; texts with apostrophes (contractions) use the pattern itself. Texts that
hold an added token of the tokenizer (such as its end-of-text mark) are left to the library whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from ringwatch.llm.words import strings, take_ranges, utf8

#: Unicode White_Space, as the pre-tokenizer's \s.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_UNKNOWN = 255
#: Printable bytes stand for themselves in the vocabulary, the others for code points from 256.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder:
    """Ids of texts as unsigned 16-bit arrays. ``keep`` bounds the cache of encoded pieces."""

    def __init__(self, path: str, keep: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.keep, self.cache = keep, {}
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.classes[_SPACES] = 0

    def _class(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == _UNKNOWN).any():
            for p in np.unique(points[found == _UNKNOWN]).tolist():
                self.classes[p] = {"L": 1, "N": 2}.get(unicodedata.category(chr(p))[0], 3)
            found = self.classes[points]
        return found

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where pieces start."""
        head = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.searchsorted(head, offsets)
        kind = self._class(points)
        solid = kind != 0
        first = np.zeros(len(points) + 1, bool)
        first[bounds] = True
        last, first = first[1:], first[:-1]
        start = first.copy()
        before, now = solid[:-1], solid[1:]
        start[1:] |= now & before & (kind[1:] != kind[:-1])
        start[1:] |= now & ~before & (points[:-1] != 0x20)
        start[1:] |= ~now & before
        start[:-1] |= ~before & now & ~last[:-1]
        if (quoted := raw == 0x27).any():
            import public_tokenizers
            import regex

            rule = regex.compile(public_tokenizers.PATTERN)
            for i in np.unique(np.searchsorted(offsets, np.flatnonzero(quoted), "right") - 1).tolist():
                a, b = bounds[i], bounds[i + 1]
                start[a:b] = False
                text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass")
                start[a + np.fromiter((m.start() for m in rule.finditer(text)), np.int64)] = True
        return head[np.flatnonzero(start)]

    def _marked(self, raw: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that hold an added token."""
        data, found = raw.tobytes(), set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                found.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = data.find(token, at + 1)
        return sorted(found)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        raw, offsets = utf8(texts)
        if not len(raw):
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        if not (marked := self._marked(raw, offsets)):
            return self._plain(raw, offsets)
        runs, counts, last = [], [], 0
        for i in [*marked, len(texts)]:
            ids, n = self._plain(raw[offsets[last] : offsets[i]], offsets[last : i + 1] - offsets[last])
            runs.append(ids)
            counts.append(n)
            if i < len(texts):
                text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass")
                runs.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16))
                counts.append(np.array([len(runs[-1])], np.int64))
            last = i + 1
        return np.concatenate(runs), np.concatenate(counts)

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        at = self._pieces(raw, offsets)
        pieces = strings(raw, np.diff(np.append(at, len(raw)))).dictionary_encode()
        values = pieces.dictionary.to_pylist()
        if len(self.cache) > self.keep:
            self.cache.clear()
        cache = self.cache
        if fresh := [v for v in values if v not in cache]:
            merge = self.library.model.tokenize
            for v in fresh:
                cache[v] = np.array([t.id for t in merge(v.decode("latin-1").translate(_LETTERS))], np.uint16).tobytes()
        coded = [cache[v] for v in values]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        flat = np.frombuffer(b"".join(coded), np.uint16)
        index = pieces.indices.to_numpy()
        counts = lengths[index]
        ids = take_ranges(flat, (np.cumsum(lengths) - lengths)[index], counts)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[np.searchsorted(at, offsets)])
