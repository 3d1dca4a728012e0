"""Kernels between rows and a bounded set of landmarks, and whole-table kernel figures from moments.

A kernel of all rows with all rows is never made: its trace, mean, deviation and
alignment with labels are sums of products of coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import let
from .selection import lot

LANDMARKS, RIDGE, NEGATIVE = 32, 1e-6, 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def landmarks(rows: DataFrame, id: str, lineage: str, label: str, seed: int = 0, most: int = LANDMARKS) -> DataFrame:  # noqa: A002
    """Balanced landmarks, one per lineage (its least id), in seeded order, classes interleaved: (id, label, ordinal)."""
    own = rows.groupBy(lineage).agg(F.min_by(F.struct(F.col(id), F.col(label)), id).alias("r")).select("r.*")
    r = own.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("classes")).first()
    each = min(most // r.classes, r.least) if r.classes else 0
    w = Window.partitionBy(label).orderBy(lot(id, seed), id)
    return own.withColumn("ordinal", F.row_number().over(w) - 1).filter(F.col("ordinal") < each).orderBy("ordinal", label)


def cross_kernel(rows: DataFrame, id: str, x: str, marks: list[tuple[int, list[float]]], gamma: float | None = None) -> DataFrame:  # noqa: A002
    """(id, mark, k): every row against the landmarks (mark, x), which go along as literals; dot products without gamma."""
    k = lambda m: dot(F.col(x), F.lit(m)) if gamma is None else rbf(F.col(x), F.lit(m), gamma)
    return rows.select(id, F.inline(F.array(*[F.struct(F.lit(name).alias("mark"), k(m).alias("k")) for name, m in marks])))


def basis(k: np.ndarray) -> np.ndarray:
    """Regularised inverse root of a landmark kernel."""
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    if values.min() < -NEGATIVE * max(1.0, values.max()):
        raise ValueError("the landmark kernel has a negative eigenvalue")
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + RIDGE)) @ vectors.T
    return (root + root.T) / 2


def embed(x: Column, marks: np.ndarray, gamma: float) -> Column:
    """struct<z, residual>: coordinates among the landmarks and what they leave unexplained of a row's own kernel value, 1."""
    own = np.exp(-gamma * ((marks[:, None, :] - marks[None, :, :]) ** 2).sum(axis=2))
    b = basis(own)
    near = F.transform(F.lit(marks.tolist()), lambda m: rbf(x, m, gamma))
    z = let(near, lambda k: F.transform(F.lit(b.tolist()), lambda row: dot(k, row)))
    return let(z, lambda z: F.struct(z.alias("z"), F.greatest(F.lit(0.0), 1 - dot(z, z)).alias("residual")))


def moments(rows: DataFrame, x: str, y: Column) -> tuple[int, np.ndarray, float, np.ndarray, float, np.ndarray, float]:
    """n, sum of x, of y, of x x', of y y, of x y and of |x|^4, of all rows: partial sums of each task, added up."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                v, t = np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy(float)
                z = np.concatenate([np.ones((len(v), 1)), t[:, None], v], axis=1)
                own = np.append((z.T @ z).ravel(), ((v * v).sum(axis=1) ** 2).sum())
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    sums = rows.select(F.col(x).alias("x"), y.cast("double").alias("y")).mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    v = np.array([r.v for r in sums.orderBy("k").collect()])  # (2 + width)^2 + 1 numbers
    d = round(np.sqrt(len(v) - 1))
    m = v[:-1].reshape(d, d)
    return int(m[0, 0]), m[0, 2:], float(m[0, 1]), m[2:, 2:], float(m[1, 1]), m[1, 2:], float(v[-1])


def alignment_loss(rows: DataFrame, x: str, y: Column) -> float:
    """One less the centred alignment of the dot-product kernel of all rows with that of their labels."""
    n, sx, sy, xx, yy, xy, _ = moments(rows, x, y)
    cov, cross, spread = xx - np.outer(sx, sx) / n, xy - sx * sy / n, yy - sy * sy / n
    return float(1 - cross @ cross / (np.sqrt((cov * cov).sum()) * spread))


def gram_figures(rows: DataFrame, x: str) -> dict[str, float]:
    """trace, off-diagonal mean and population deviation of the dot-product kernel of all rows; effective rank."""
    n, sx, _, xx, _, _, fourth = moments(rows, x, F.lit(0.0))
    trace, pairs = float(np.trace(xx)), n * (n - 1)
    mean = (sx @ sx - trace) / pairs
    p = np.clip(np.linalg.eigvalsh(xx), 0, None)  # the kernel's eigenvalues but for zeros
    p = p[p > 0] / p.sum()
    return {"trace": trace, "off_mean": float(mean), "off_sd": float(np.sqrt(max(0.0, ((xx * xx).sum() - fourth) / pairs - mean * mean))), "effective_rank": float(np.exp(-(p * np.log(p)).sum()))}
