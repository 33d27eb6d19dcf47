"""Vectorized splitting of texts inside Arrow batches.

Everything works on whole batches of UTF-8 bytes with numpy; distinct words reach Python code
once a batch, through Arrow's dictionary encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no part of a word of letters and digits: all of ASCII but 0-9, A-Z and a-z.
MARK = np.ones(256, bool)
MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def merged(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until ``column`` holds about ``most`` bytes, to spread fixed costs."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the int64 offsets of each; a null text is empty."""
    wide = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(wide, pa.ChunkedArray):
        wide = wide.combine_chunks()
    n = len(wide)
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + n + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if n else raw[:0], offsets - offsets[0]


def strings(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Arrow binary array over consecutive pieces of ``raw``."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def split_words(texts: pa.Array, lower: bool = True, between: np.ndarray = SPACE) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words (lower-cased): index of each into the distinct words, those, words per text. ``between`` marks the bytes between words."""
    raw, offsets = utf8(texts)
    if not len(raw):
        return np.zeros(0, np.int32), pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    space = between[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start, end = ~space, ~space
    start[1:] &= space[:-1] | edge[1:-1]
    end[:-1] &= space[1:] | edge[1:-1]
    at = np.flatnonzero(start)
    lengths = np.flatnonzero(end) - at + 1
    del start, end, edge
    solid = raw[~space]
    encoded = strings(LOWER[solid] if lower else solid, lengths).dictionary_encode()
    return encoded.indices.to_numpy(), encoded.dictionary, np.diff(np.searchsorted(at, offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(values: pa.Array) -> np.ndarray:
    """64-bit hash of each byte string."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


def take_ranges(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[s : s + c]`` for each start and count."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]
