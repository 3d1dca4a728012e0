"""Eigenvalues of a kernel of all rows, with a certificate, from pivots that the rows choose.

The kernel is never made.  Pivots are drawn in rounds: each row's residual, what the
pivots so far leave unexplained of its own kernel value, is its chance (a seeded order
by a hash over the residual).  A round is one pass: kernel values with the new pivots
are worked out in the tasks, coordinates come from the inverse of the pivots'
Cholesky factor, and only
sums of products of coordinates and the round's next pivots leave them.

The pivots' approximation never exceeds the kernel, so with `error` = trace of the
kernel less that of the approximation, each eigenvalue is at least the found one and at
most `error` more, and so is the sum of any of them.  It ends when error is below the
tolerance times the trace, or at `most` pivots.

The kernel's norm has no such short way: norm() works out every pair, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored, temporary
from .grid import added

ROUND, RUN = 64, 2048
#: Rows of a block of norm(), and of a part of it that meets the other block at once.
BLOCK, PART = 8192, 512


def _kernel(x: np.ndarray, marks: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (marks * marks).sum(axis=1)[None, :] - 2 * x @ marks.T
    return np.exp(-gamma * np.maximum(d, 0))


def _longer(inverse: np.ndarray, marks: np.ndarray, row: np.ndarray, gamma: float) -> np.ndarray | None:
    """The inverse of the pivots' lower Cholesky factor with one more pivot; None if they tell its row already."""
    z = inverse @ _kernel(row[None, :], marks, gamma)[0] if len(marks) else np.zeros(0)
    left = 1 - z @ z
    if left <= 1e-10:
        return None
    out = np.zeros((len(marks) + 1, len(marks) + 1))
    out[:-1, :-1], out[-1, :-1], out[-1, -1] = inverse, -(z @ inverse) / np.sqrt(left), 1 / np.sqrt(left)
    return out


def _round(marks: np.ndarray, inverse: np.ndarray, gamma: float, wanted: int):
    """Of one task: rows, residual's sum, products of coordinates, and the rows that would be the next pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, left, products = 0, 0.0, np.zeros((len(marks), len(marks)))
        best: list[tuple[float, int, list[float]]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                lots, x = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                residual = np.ones(len(x))
                if len(marks):
                    z = _kernel(x, marks, gamma) @ inverse.T
                    residual = np.maximum(0.0, 1 - (z * z).sum(axis=1))
                    products += z.T @ z
                n, left = n + len(x), left + residual.sum()
                with np.errstate(divide="ignore"):
                    arrival = np.where(residual > 1e-12, -np.log(lots) / residual, np.inf)  # the first of a race at these rates
                for i in np.argsort(arrival)[:wanted]:
                    if np.isfinite(arrival[i]):
                        best.append((float(arrival[i]), len(best), x[i].tolist()))
                best = sorted(best)[:wanted]
        sums = [(0, -1, [n, left]), *[(0, i, v.tolist()) for i, v in enumerate(products)], *[(1, 0, [b[0], *b[2]]) for b in best]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in sums], pa.int32()), pa.array([r[1] for r in sums], pa.int32()), pa.array([r[2] for r in sums], pa.list_(pa.float64()))], ["candidate", "i", "v"])

    return run


def spectrum(rows: DataFrame, id: str, x: str, gamma: float, tolerance: float = 0.01, most: int = 512, seed: int = 0) -> dict[str, object]:  # noqa: A002
    """eigenvalues (falling), trace, error, frobenius (of the approximation), effective_rank, pivots, of exp(-gamma d^2) over all rows."""
    lot = (F.abs(F.xxhash64(F.lit(seed), id) % (1 << 52)) + 0.5) / float(1 << 52)
    ready = rows.select(lot.alias("lot"), F.col(x).cast("array<double>").alias("x"))
    marks: list[list[float]] = []
    inverse = np.zeros((0, 0))
    while True:
        kind = "candidate int, i int, v array<double>"
        with temporary(rows.sparkSession):
            made = stored(ready.mapInArrow(_round(np.array(marks), inverse, gamma, min(ROUND, most - len(marks))), kind))
            n, left, products = 0, 0.0, np.zeros((len(marks), len(marks)))
            for r in made.filter("candidate = 0").repartition("i").mapInArrow(added, kind).collect():  # a row for each pivot
                if r.i < 0:
                    n, left = int(r.v[0]), r.v[1]
                else:
                    products[r.i] = r.v
            next_ = [(r.v[0], r.v[1:]) for r in made.filter("candidate = 1").orderBy("v").limit(ROUND).collect()]
        if marks and (left <= tolerance * n or len(marks) >= most or not next_):
            break
        before = len(marks)
        for _, row in next_[: most - len(marks)]:
            longer = _longer(inverse, np.array(marks), np.array(row), gamma)
            if longer is not None:
                inverse = longer
                marks.append(row)
        if len(marks) == before:
            break
    values = np.clip(np.linalg.eigvalsh(products)[::-1], 0, None)
    p = values[values > 0] / values.sum()
    return {"eigenvalues": values, "trace": float(n), "error": float(left), "frobenius": float(np.sqrt((values * values).sum())), "effective_rank": float(np.exp(-(p * np.log(p)).sum())), "pivots": len(marks)}


def norm(rows: DataFrame, id: str, x: str, gamma: float, block: int = BLOCK) -> tuple[int, float]:  # noqa: A002
    """Rows that have a vector, and the Frobenius norm of exp(-gamma d^2) over all pairs of them, exact but for rounding.

    Rows are dealt into blocks by a hash, and each two blocks meet in one group of at most about twice `block` rows.  The work grows with
    the square of the rows; a task holds two blocks and a strip of their kernel.
    """

    def squares(key: tuple, pair: pa.Table) -> pa.Table:
        low, high = (k.as_py() for k in key)
        own, v = pair.column("own").to_numpy(), pair.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(pair.num_rows, -1)
        a, b = v[own == low], v[own == high]
        found = sum(float(_kernel(a[at : at + PART], b, 2 * gamma).sum()) for at in range(0, len(a), PART))
        return pa.table({"v": pa.array([found if low == high else 2 * found], pa.float64())})

    with temporary(rows.sparkSession):
        ready = stored(rows.filter(F.col(x).isNotNull()).select(F.xxhash64(id).alias("lot"), F.col(x).cast("array<double>").alias("x")))
        n = ready.count()
        blocks = -(-n // min(block, max(256, n // 8)))
        own, other = F.pmod("lot", F.lit(blocks)).cast("int"), F.col("other")
        dealt = ready.select(own.alias("own"), "x", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("other"))
        met = dealt.select(F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), "own", "x")
        total = met.groupBy("low", "high").applyInArrow(squares, "v double").agg(F.sum("v")).first()[0] if n else 0.0
    return n, float(np.sqrt(total))
