"""Poisson bootstrap for statistics that are no sums of counts: AUC and quantiles.

In each replicate a row counts as often as a Poisson number of mean 1 says, which
comes from a hash of the row's id and the replicate.  So rows are never drawn, every
layout of the table gives the same replicates, and all replicates are worked out in one
pass over rows that are sorted over ranges: a range leaves a few numbers a replicate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the hash: steps of id and replicate, and the multiplier of its two rounds, modulo 2**32.
OF_ID, OF_REPLICATE, ROUND = 1_000_003, 7_919, 73_244_475
#: Hashes below the k-th of these make a count of k or less.
TABLE = [int(sum(exp(-1) / factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]
#: Rows at once, and rows that one task may sort at the end of quantile().
RUN, LAST = 256, 20_000


def counts(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Rows by replicates, behind a first column of ones for the table itself."""
    low = np.uint64(2**32 - 1)
    h = ((ids.astype(np.int64) % 2**32).astype(np.uint64)[:, None] * np.uint64(OF_ID) + np.arange(replicates, dtype=np.uint64)[None, :] * np.uint64(OF_REPLICATE) + np.uint64(seed)) & low
    for _ in range(2):
        h = ((h ^ (h >> np.uint64(16))) * np.uint64(ROUND)) & low
    h ^= h >> np.uint64(16)
    return np.column_stack([np.ones(len(ids)), np.searchsorted(np.array(TABLE, np.uint64), h, side="right")])


@dataclass
class Ranked:
    """Weights of positives and negatives of a run of sorted scores, and pairs in the right order (ties half)."""

    first: float
    last: float
    pos: np.ndarray
    neg: np.ndarray
    pairs: np.ndarray
    head: tuple[np.ndarray, np.ndarray]  # of the first score
    tail: tuple[np.ndarray, np.ndarray]  # of the last

    def __add__(self, b: Ranked) -> Ranked:
        pairs = self.pairs + b.pairs + self.neg * b.pos
        head, tail = self.head, b.tail
        if self.last == b.first:
            pairs = pairs + (b.head[1] * self.tail[0] - self.tail[1] * b.head[0]) / 2
            if self.first == self.last:
                head = (self.head[0] + b.head[0], self.head[1] + b.head[1])
            if b.first == b.last:
                tail = (self.tail[0] + b.tail[0], self.tail[1] + b.tail[1])
        return Ranked(self.first, b.last, self.pos + b.pos, self.neg + b.neg, pairs, head, tail)


def ranked(scores: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> Ranked:
    """Of sorted scores."""
    starts = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
    p = np.add.reduceat(weights * positive[:, None], starts, axis=0)
    n = np.add.reduceat(weights * ~positive[:, None], starts, axis=0)
    before = np.cumsum(n, axis=0) - n
    return Ranked(scores[0], scores[-1], p.sum(axis=0), n.sum(axis=0), (p * (before + n / 2)).sum(axis=0), (p[0], n[0]), (p[-1], n[-1]))


_PARTS = ["pos", "neg", "pairs", "hp", "hn", "tp", "tn"]


def aucs(rows: DataFrame, id: str, positive: Column, score: str, replicates: int, seed: int = 0) -> np.ndarray:  # noqa: A002
    """AUC of the table and of each replicate; NaN where a side is empty.  Rows without a score are left out."""
    ready = rows.select(F.col(id).cast("long").alias("id"), F.coalesce(positive, F.lit(False)).alias("p"), F.col(score).cast("double").alias("s")).filter("s is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                i, p, s = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, RUN).columns)
                own = ranked(s, p, counts(i, replicates, seed))
                total = own if total is None else total + own
        if total is not None:
            arrays = [total.pos, total.neg, total.pairs, *total.head, *total.tail]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.first]), pa.array([total.last]), *[pa.array([a.tolist()]) for a in arrays]], ["part", "first", "last", *_PARTS])

    kinds = "part long, first double, last double, " + ", ".join(f"{c} array<double>" for c in _PARTS)
    parts = ready.repartitionByRange("s", "id").sortWithinPartitions("s", "id").mapInArrow(run, kinds).collect()  # a row for each range
    total = None
    for r in sorted(parts, key=lambda r: r.part):
        a = [np.array(r[c]) for c in _PARTS]
        own = Ranked(r.first, r.last, a[0], a[1], a[2], (a[3], a[4]), (a[5], a[6]))
        total = own if total is None else total + own
    if total is None:
        return np.full(replicates + 1, np.nan)
    both = total.pos * total.neg
    return np.where(both > 0, total.pairs / np.where(both > 0, both, 1), np.nan)


def quantiles(rows: DataFrame, id: str, value: str, q: float, replicates: int, seed: int = 0) -> np.ndarray:  # noqa: A002
    """The linear q quantile of the table and of each replicate; NaN where a replicate is empty.  Null values are left out.

    Ranges are summed, the ones that hold what the replicates ask for are cut into ranges again, and so on until one
    task can sort them (LAST rows) or one value is left.
    """
    ready = rows.select(F.col(id).cast("long").alias("id"), F.col(value).cast("double").alias("s")).filter("s is not null")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last, total = 0, None, None, np.zeros(replicates + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                i, s = (c.to_numpy() for c in batch.slice(at, RUN).columns)
                total += counts(i, replicates, seed).sum(axis=0)
                n, first, last = n + len(i), s.min() if first is None else min(first, s.min()), s.max() if last is None else max(last, s.max())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([first]), pa.array([last]), pa.array([total.tolist()])], ["part", "n", "first", "last", "w"])

    kinds = "part long, n long, first double, last double, w array<double>"
    low, high, below, want = None, None, np.zeros(replicates + 1), None
    while True:
        window = ready if low is None else ready.filter((F.col("s") >= low) & (F.col("s") <= high))
        parts = sorted(window.repartitionByRange("s", "id").mapInArrow(sums, kinds).collect(), key=lambda r: r.part)
        if not parts:
            return np.full(replicates + 1, np.nan)
        upto = below + np.cumsum([r.w for r in parts], axis=0)
        if want is None:
            want = (upto[-1] - 1) * q
            full = upto[-1] > 0
        at = lambda p: np.argmax(upto > p, axis=0)[full]
        a, b = int(at(np.floor(want)).min()), int(at(np.ceil(want)).max())
        new = parts[a].first, parts[b].last
        rows_left = sum(r.n for r in parts[a : b + 1])
        done = rows_left <= LAST or new[0] == new[1] or (low, high) == new
        low, high = new
        if done:
            break
        below = _below(ready, low, sums, kinds, replicates)
    below = _below(ready, low, sums, kinds, replicates)
    out = np.full(replicates + 1, np.nan)
    if low == high:
        out[full] = low
        return out
    last = ready.filter((F.col("s") >= low) & (F.col("s") <= high)).toArrow()  # LAST rows and ties of the ends
    i, s = last["id"].to_numpy(), last["s"].to_numpy()
    order = np.lexsort((i, s))
    i, s = i[order], s[order]
    upto = below + np.cumsum(np.concatenate([counts(i[a : a + RUN], replicates, seed) for a in range(0, len(i), RUN)]), axis=0)
    for k in np.flatnonzero(full):
        x, y = (s[np.searchsorted(upto[:, k], p, side="right")] for p in (np.floor(want[k]), np.ceil(want[k])))
        out[k] = x + (y - x) * (want[k] - np.floor(want[k]))
    return out


def _below(ready: DataFrame, low: float, sums, kinds: str, replicates: int) -> np.ndarray:
    parts = ready.filter(F.col("s") < low).mapInArrow(sums, kinds).collect()
    return np.sum([r.w for r in parts], axis=0) if parts else np.zeros(replicates + 1)


def interval(values: np.ndarray) -> tuple[float, float, float, int]:
    """(the table's value, 2.5 % and 97.5 % linear quantiles of the replicates, replicates that have one)."""
    own = values[1:][~np.isnan(values[1:])]
    low, high = np.quantile(own, [0.025, 0.975]) if len(own) else (np.nan, np.nan)
    return float(values[0]), float(low), float(high), len(own)
