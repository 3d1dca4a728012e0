"""Words and shingles of Arrow text columns as NumPy arrays.

Texts stay in Arrow's byte buffers: word borders and 64-bit word hashes of a
whole batch come from a few array passes, so no Python string is made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What is left of eight bytes when so many of them belong to a span.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans longer than so many bytes are hashed one by one.
LONG = 64
#: Bytes handled at once; a longer text is a part of its own.
PART = 1 << 20
SHINGLE = 5
_MIX = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def parts(offsets: np.ndarray, most: int = PART):
    """(first row, row after the last) of consecutive parts of at most `most` bytes or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[0] = after[-1] = False
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets)


class Bytes:
    """Spans of a byte buffer, eight bytes at a time.  spare: data has eight bytes more than it uses."""

    def __init__(self, data: np.ndarray, spare: bool = False) -> None:
        self.data = data
        if not spare:
            data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))

    def chunk(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The bytes from `at` on as integers, of which `left` (8 at most count) belong to the span."""
        return self.eight[at] & _LEFT[np.minimum(left, 8)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span, chained over its chunks by a finaliser, which is no sum that texts could cancel."""
        size = ends - starts
        out = mix64(size.astype(np.uint64))
        which, at = np.flatnonzero(size <= LONG), 0
        while len(which):
            out[which] = mix64(out[which] ^ self.chunk(starts[which] + at, size[which] - at))
            at += 8
            which = which[size[which] > at]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def equal(self, starts: np.ndarray, other: Bytes, others: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether spans of `size` bytes here and in the other buffer are the same bytes."""
        out = np.ones(len(starts), bool)
        which, at = np.flatnonzero(size <= LONG), 0
        while len(which):
            left = size[which] - at
            out[which] &= self.chunk(starts[which] + at, left) == other.chunk(others[which] + at, left)
            at += 8
            which = which[size[which] > at]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = np.array_equal(self.data[starts[i] : starts[i] + size[i]], other.data[others[i] : others[i] + size[i]])
        return out


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return Bytes(data).hashes(starts, ends)


def word_hashes(column: pa.Array):
    """For each row its word hashes, in the text's order (an iterator over rows)."""
    data, offsets = buffers(column)
    for a, b in parts(offsets):
        own = data[offsets[a] : offsets[b]]
        starts, ends, first = spans(own, offsets[a : b + 1] - offsets[a])
        hashed = hashes(own, starts, ends)
        for i in range(b - a):
            yield hashed[first[i] : first[i + 1]]


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words; fewer words are one shingle, none are none."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        out += words[j : n - size + 1 + j] * _MIX[j]
    return mix64(out + np.uint64(size))


def combine(values: np.ndarray, salt: int) -> np.ndarray:
    """One hash for each row of a matrix of hashes."""
    return mix64((values * _MIX[: values.shape[-1]]).sum(axis=-1, dtype=np.uint64) + np.uint64(salt))
