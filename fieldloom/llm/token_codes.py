"""Token-id files with directly addressable codes.

Ids are split into 8-bit chunks, lowest first.  Level k holds the k-th chunk of
every id that has one, a continuation bitmap per level says which ids go on to
the next, and a rank directory (ones before every 512 bits) turns an id's place
on one level into its place on the next.  Any id is read from a handful of
bytes; no block is decoded.

A table of segments is written with Spark's Parquet writer (so commits survive
lost executors and any store works): each row holds the codes of whole documents
in doc_id order, about SEGMENT ids.  Layout of `codes`, little-endian:

    b"DAC1", uint32 levels, then for each level
        uint64 n, n chunk bytes padded to 8, ceil(n/64) bitmap words, ceil(n/512)+1 uint32 ranks padded to 8
    (the last level has neither bitmap nor ranks)

Defined cases: null text is empty and gives the end id alone; rows with equal
doc_id are ordered by text; null doc_id comes first; an empty table gives an
empty one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from ._common import in_short_batches, shared_folder, small

SEGMENT = 1 << 18
BLOCK = 512
SEGMENTS = "part int, segment int, at long, n_ids long, doc_ids array<long>, starts array<long>, codes binary"


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def encode(ids: np.ndarray) -> bytes:
    """Codes of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [b"DAC1", struct.pack("<I", len(levels))]
    for k, (chunks, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunks)), _pad(chunks.tobytes())]
        if k + 1 < len(levels):
            out.append(_pad(np.packbits(more, bitorder="little").tobytes()))
            ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
            out.append(_pad(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()))
    return b"".join(out)


class Codes:
    """Reads ids from codes by their place."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != b"DAC1":
            raise ValueError("these bytes are no DAC1 codes")
        self.levels, at = [], 8
        count = struct.unpack_from("<I", raw, 4)[0]
        for k in range(count):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            chunks = np.frombuffer(raw, np.uint8, n, at)
            at += -(-n // 8) * 8
            bits = ranks = None
            if k + 1 < count:
                words = -(-n // 64)
                bits = np.frombuffer(raw, "<u8", words, at)
                at += 8 * words
                blocks = -(-n // BLOCK) + 1
                ranks = np.frombuffer(raw, "<u4", blocks, at)
                at += -(-4 * blocks // 8) * 8
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        places = np.asarray(places, np.int64)
        out, which = np.zeros(len(places), np.uint32), np.arange(len(places))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[which] |= chunks[places].astype(np.uint32) << np.uint32(8 * k)
            if bits is None:
                break
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            on = (bits[word] >> bit) & np.uint64(1) == 1
            which, places, word, bit = which[on], places[on], word[on], bit[on]
            rank = ranks[places // BLOCK].astype(np.int64)
            first = places // BLOCK * (BLOCK // 64)
            for step in range(BLOCK // 64):
                before = first + step < word
                rank[before] += np.bitwise_count(bits[first[before] + step])
            rank += np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            places = rank
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of a run: each level's part is a run too, so only its ends are ranked."""
        out, which, a, b = np.zeros(stop - start, np.uint32), None, start, stop
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            part = chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if which is None:
                out |= part
            else:
                out[which] |= part
            if bits is None or a == b:
                break
            on = np.flatnonzero(np.unpackbits(bits[a >> 6 : -(-b // 64)].view(np.uint8), bitorder="little")[a & 63 : (a & 63) + b - a])
            which = on if which is None else which[on]
            a = self._rank(bits, ranks, a)
            b = a + len(on)
        return out

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, place: int) -> int:
        block, word = place // BLOCK, place >> 6
        rank = int(ranks[block]) + int(np.bitwise_count(bits[block * (BLOCK // 64) : word]).sum())
        return rank + (int(bits[word]) & ((1 << (place & 63)) - 1)).bit_count() if place & 63 else rank


def _writer(path: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        held_ids: list[np.ndarray] = []
        held_docs: list[int | None] = []
        held_counts: list[int] = []
        at = segment = part = 0

        def flush() -> pa.RecordBatch:
            nonlocal at, segment
            ids = np.concatenate(held_ids)
            counts = np.array(held_counts, np.int64)
            rows = {"part": [part], "segment": [segment], "at": [at], "n_ids": [len(ids)], "doc_ids": [list(held_docs)], "starts": [np.cumsum(counts) - counts], "codes": [encode(ids)]}
            at, segment = at + len(ids), segment + 1
            for x in (held_ids, held_docs, held_counts):
                x.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                part = some.column(0)[0].as_py()
                ids, offsets = coder.encode(some.column(2))
                ids = np.insert(ids, offsets[1:], end)
                offsets = offsets + np.arange(len(offsets))
                # Cut between documents where a segment is full.
                docs, row = some.column(1).to_pylist(), 0
                while row < len(docs):
                    stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT - size, "left")))
                    stop = min(stop, len(docs))
                    held_ids.append(ids[offsets[row] : offsets[stop]])
                    held_docs.extend(docs[row:stop])
                    held_counts.extend(np.diff(offsets[row : stop + 1]).tolist())
                    size += int(offsets[stop] - offsets[row])
                    row = stop
                    if size >= SEGMENT:
                        yield flush()
                        size = 0
        if held_docs:
            yield flush()

    return write


def write_codes(docs: DataFrame, path: str, tokenizer: str, end: int, text: str = "text", id: str = "doc_id") -> str:  # noqa: A002
    """Write the ids of docs' whole texts, each with `end` behind it, in ascending id order."""
    placed = in_short_batches(docs).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_writer(tokenizer, end), SEGMENTS).write.parquet(path)
    return path


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The written segments with `base`, the number of ids before each."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each writing task.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(small(before), "part").withColumn("base", F.col("before") + F.col("at")).drop("before")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, starts = Codes(row["codes"]), [*row["starts"], row["n_ids"]]
                crc = [zlib.crc32(codes.slice(a, b).astype("<u4").tobytes()) for a, b in zip(starts, starts[1:], strict=False)]
                starts = np.array(starts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    some = segments(spark, path).select("base", "n_ids", "doc_ids", "starts", "codes")
    return some.mapInArrow(reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    spark = docs.sparkSession
    return documents(spark, write_codes(docs, shared_folder(spark), tokenizer, end))
