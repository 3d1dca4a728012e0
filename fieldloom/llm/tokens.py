"""Ids from the tokenizers library, with a bounded table of space-led pieces.

Encoding is cut at single ASCII spaces, where the pre-tokenizers of both kinds
of file always end a token, so the ids of the whole text are those of its
pieces in order.  Each distinct piece goes to the library once while the table
holds it.  Where a cut could change a token (a space inside longer white space,
special-token strings) the whole text goes to the library instead.

The table finds a piece by a 64-bit hash and holds its bytes, which are compared
on every hit: a text with a piece that only shares another's hash goes to the
library whole, so ids never depend on hashes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from . import words

#: White space on both sides of a space: there a byte-level token may span it.
_INNER = re.compile(r"\s (?:\s|\Z)")
#: Bytes that may end or begin a white-space character (a superset; such texts are looked at again).
_ENDS, _BEGINS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BEGINS[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Pieces and their bytes that the table holds at most, and bytes of text encoded at once.
MOST, MOST_BYTES, GROUP = 1_500_000, 64 << 20, 4 << 20
_FIRST = np.uint64(0x5851F42D4C957F2D)


def _append(pool: np.ndarray, used: int, new: np.ndarray, sizes: np.ndarray, spare: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pool, grown to hold new behind its `used` first, and where each of the runs of `sizes` begins."""
    total = used + len(new)
    if total + spare > len(pool):
        pool = np.concatenate([pool[:used], np.zeros(max(total + spare, 2 * len(pool)) - used, pool.dtype)])
    pool[used:total] = new
    return pool, used + np.cumsum(sizes) - sizes


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Byte-level files keep the space as part of the next token; files with word ends drop it.
        self.keeps_space = self.tokenizer.normalizer is None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by key; the rest by slot
        self.begin = self.count = self.place = self.size = np.zeros(0, np.int32)
        self.first = np.zeros(0, bool)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.held = np.zeros(1 << 16, np.uint8), 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[bytes], first: np.ndarray) -> None:
        found = self._library([(" " if self.keeps_space and not f else "") + x.decode() for x, f in zip(pieces, first.tolist(), strict=True)])
        count = np.fromiter(map(len, found), np.int64, len(found))
        self.pool, begin = _append(self.pool, self.used, np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum())), count)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.raw, place = _append(self.raw, self.held, np.frombuffer(b"".join(pieces), np.uint8), size, 8)
        self.used, self.held = self.used + int(count.sum()), self.held + int(size.sum())
        slots = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        for name, new in (("begin", begin), ("count", count), ("place", place), ("size", size), ("first", first)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, new.astype(old.dtype)]))
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        self.keys, self.slot = both[order], np.concatenate([self.slot, slots])[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column's rows (null: none) in order, and the offset of each row in them."""
        data, offsets = words.buffers(column)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in words.parts(offsets, GROUP):
            x, n = self._group(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(x)
            counts.append(n)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _direct(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose whole text goes to the library."""
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        out = set(np.searchsorted(offsets, marks, "right") - 1)
        if self.keeps_space:
            before = np.concatenate([[False], _ENDS[data[:-1]]])
            after = np.concatenate([_BEGINS[data[1:]], [True]])
            after[offsets[1:][offsets[1:] > 0] - 1] = True
            at = np.flatnonzero((data == 32) & before & after)
            for i in set(np.searchsorted(offsets, at, "right") - 1) - out:
                if _INNER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode()):
                    out.add(i)
        return np.array(sorted(out), np.int64)

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        direct = self._direct(data, offsets)
        # Pieces: from a row's start or behind a space, up to the next space or the row's end.
        blank = np.flatnonzero(data == 32)
        rows = np.flatnonzero(np.diff(offsets))  # rows with bytes
        # Sorted by place; where two meet, the lowest bit puts the earlier row's first.
        marks = np.sort(np.concatenate([offsets[rows] * 2 + 1, blank * 2 + 2]))
        starts, owner = marks >> 1, rows[np.cumsum(marks & 1) - 1]
        ends = np.sort(np.concatenate([blank * 2 + 1, offsets[rows + 1] * 2])) >> 1
        if len(direct):
            own = ~np.isin(owner, direct)
            starts, ends, owner = starts[own], ends[own], owner[own]
        first, size, own = np.diff(owner, prepend=-1) != 0, ends - starts, words.Bytes(data)
        if not self.keeps_space:  # a space is dropped, so it makes no difference
            first = np.zeros(len(starts), bool)
        keys = own.hashes(starts, ends) ^ np.where(first, _FIRST, np.uint64(0))
        unique, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        lacks = np.ones(len(unique), bool)
        inside = at < len(self.keys)
        lacks[inside] = self.keys[at[inside]] != unique[inside]
        if lacks.any():
            if len(self.keys) + int(lacks.sum()) > MOST or self.held + int(size[where[lacks]].sum()) > MOST_BYTES:
                self._forget()
                lacks[:] = True
            raw, new = data.tobytes(), where[lacks]
            self._learn(unique[lacks], [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], first[new])
            at = np.searchsorted(self.keys, unique)
        slot = self.slot[at][inverse]
        known = (self.size[slot] == size) & (self.first[slot] == first)
        hit = np.flatnonzero(known)
        known[hit] = own.equal(starts[hit], words.Bytes(self.raw, True), self.place[slot[hit]], size[hit])
        begin, count = self.begin[slot], self.count[slot]
        if not known.all():  # a foreign piece of the same hash
            odd = np.unique(owner[~known])
            count = np.where(np.isin(owner, odd), 0, count)
            direct = np.union1d(direct, odd)
        stop = np.cumsum(count, dtype=np.int64)
        ids = self.pool[np.repeat(begin - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)]
        counts = np.bincount(owner, weights=count, minlength=n).astype(np.int64)
        if len(direct):
            ids, counts = self._put(ids, counts, direct, data, offsets)
        return ids, counts

    def _put(self, ids, counts, direct, data, offsets):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in direct]
        for i, x in zip(direct.tolist(), self._library(texts), strict=True):
            parts[i] = np.array(x, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
