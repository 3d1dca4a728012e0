"""Best-fit packing with a bounded number of open bins.

Each task packs the documents it reads, online: a document's last piece goes to
the open bin with the least free space that holds it, else to a new bin.  Open
bins are found by a bitset keyed by free space (bit f is set while a bin with f
free places is open).  When more than OPEN bins are open, the fullest closes.
Pieces of full length are sequences of their own.  Pieces are placed in the order
in which they are read; none waits for another.

Nothing is shuffled and no bin is shared between tasks; each task leaves less
than one sequence's worth of bins that could have been joined, times a few.

Defined cases: null text is empty and is its end id alone; rows with the same
doc_id are documents of their own; every id is placed exactly once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from ._common import in_short_batches

LENGTH, OPEN = 2048, 512
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """Open bins by free space."""

    def __init__(self, first: int, length: int = LENGTH, most: int = OPEN) -> None:
        self.next, self.length, self.most = first, length, most
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits, self.open = 0, 0

    def put(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.length, self.next
            self.next += 1
        if space > size:
            self.free[space - size].append(bin_)
            self.bits |= 1 << (space - size)
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return bin_, self.length - space

    def _take(self, space: int) -> int:
        bin_ = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_


def _packer(path: str, end: int, length: int, most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins = tokens.encoder(path), None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                if bins is None:
                    bins = Bins(some.column(0)[0].as_py() << 40, length, most)
                ids, offsets = coder.encode(some.column(2))
                ids = np.insert(ids, offsets[1:], end).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                counts = np.diff(offsets)
                pieces = -(-counts // length)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * length
                size = np.minimum(length, counts[row] - start)
                place = np.zeros((len(row), 2), np.int64)
                for i, n in enumerate(size.tolist()):
                    place[i] = bins.put(n)
                begin = offsets[row] + start
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(1).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(place[:, 0]), pa.array(place[:, 1])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pack


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, most: int = OPEN, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """One row for each piece of docs' token ids (with `end` behind each text) and its place in a sequence."""
    read = in_short_batches(docs).select(F.spark_partition_id().alias("part"), F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(_packer(tokenizer, end, length, most), PACKED)
