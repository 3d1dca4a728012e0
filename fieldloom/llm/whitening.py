"""Whitening of embeddings from an exact integer scatter.

Each entry c becomes the integer x = floor(SCALE * c) + OFFSET.  OFFSET cancels in
every centred quantity, so tasks subtract it again and add up y = x - OFFSET: sums
S and cross-products of all vectors, without rounding, in any order and on any
number of tasks.  A task's numbers may be of any size: it writes them as signed
limbs of LIMB bits, Spark adds limbs of the same cell and place as longs, and the
driver puts the totals of dim * (dim + 1) / 2 cells together as Python integers.
n * sum(y y') - S S' is formed from these, exactly; only then is it converted to
doubles, divided by n * n and decomposed by eigh.

Within a task products go through matrix multiplication in doubles, of limbs so
short and blocks of so many rows that every sum stays below 2**53, where doubles
are exact.

Result of whiten(): for each row and component (numbered from 1 by falling
eigenvalue, at most `components`) the vector less its mean, projected and divided
by the eigenvalue's root; `deviation`, the sum over dimensions of (n * x - S)**2 as
decimal(38, 0); the eigenvalue's share of the trace; and the largest entry of the
results' own covariance less the identity, from a second pass over the results.

Defined cases.  Rows without a vector, or with a null or non-finite entry, are left
out, as are rows whose vector has not the table's length: the most frequent length
of the others, of equally frequent ones the longest; empty vectors never count.
Entries are kept within +-2**61 after scaling, so that x is a long.  Repeated
rows and rows with a null id are rows like others; extra columns are not read.
Where an eigenvalue is not positive at double precision (dim * 2**-52 of the
largest) that component can't be scaled: its `whitened` is null and it is left
out of identity_error.  Without variance `explained` is null, and identity_error
is null if no component is scaled.  A table without vectors gives no rows.  A
deviation beyond 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb that leaves a task, of a limb within products, rows multiplied at once, and the bound of scaled entries.
LIMB, SHORT, BLOCK, MOST = 32, 21, 2048, 2.0**61


def whole_numbers(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column as rows of longs: floor(SCALE * c)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.clip(np.floor(SCALE * np.clip(flat, -MOST, MOST)), -MOST, MOST)
    return scaled.astype(np.int64).reshape(len(column), -1)


def cross(y: np.ndarray) -> np.ndarray:
    """y'y of at most BLOCK rows of longs within +-MOST as Python integers, exact."""
    mask = (1 << SHORT) - 1
    limbs = [x.astype(np.float64) for x in (y & mask, (y >> SHORT) & mask, y >> (2 * SHORT))]
    out = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << (SHORT * (i + j))
    return out


def _limbs(numbers: list[int]) -> Iterator[tuple[int, int, int]]:
    """(index, place, signed limb) of each number that isn't 0."""
    for k, x in enumerate(numbers):
        sign, x, place = (-1 if x < 0 else 1), abs(x), 0
        while x:
            yield k, place, sign * (x & ((1 << LIMB) - 1))
            x >>= LIMB
            place += 1


def _scatter(dim: int):
    """Of one task: cell 0 rows, the next dim the sums, then the upper triangle of cross-products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                y = whole_numbers(batch.column(0).slice(at, BLOCK))
                n += len(y)
                low, high = int(y.min()), int(y.max())
                sums += y.astype(object if max(-low, high) >= 2**51 else np.int64).sum(axis=0).astype(object)
                if max(-low, high) < 1 << SHORT:
                    products += (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
                else:
                    products += cross(y)
        cells = list(_limbs([n, *sums.tolist(), *products[np.triu_indices(dim)].tolist()]))
        k, place, limb = zip(*cells, strict=True) if cells else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array(limb, pa.int64())], ["cell", "place", "limb"])

    return run


def scatter(vectors: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, n * sum(y y') - S S') of one column of vectors of the same length, exact."""
    parts = vectors.mapInArrow(_scatter(dim), "cell int, place int, limb long")
    numbers = [0] * (1 + dim + dim * (dim + 1) // 2)
    for r in parts.groupBy("cell", "place").agg(F.sum("limb").alias("limb")).collect():  # cells: a matter of dim
        numbers[r.cell] += r.limb << (LIMB * r.place)
    n, sums = numbers[0], numbers[1 : dim + 1]
    centred = [[0] * dim for _ in range(dim)]
    for (i, j), p in zip(zip(*np.triu_indices(dim), strict=True), numbers[dim + 1 :], strict=True):
        centred[i][j] = centred[j][i] = n * p - sums[i] * sums[j]
    return n, sums, centred


def decompose(n: int, centred: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors as columns, and trace of the covariance centred / n**2."""
    cov = np.array([[x / (n * n) for x in row] for row in centred])  # quotients of integers are rounded once
    values, vectors = np.linalg.eigh(cov)
    return values[::-1], vectors[:, ::-1], sum(centred[i][i] for i in range(len(centred))) / (n * n)


def _centred(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """Rows x - S/n as doubles, and the exact sum of (n * x - S)**2 of each."""
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
    if most < 2**62:
        d = y * n - np.array(sums, np.int64)
        exact = (d.astype(object) ** 2).sum(axis=1).tolist() if most >= 2**28 or y.shape[1] > 64 else (d * d).sum(axis=1).tolist()
        return d / n, exact
    d = y.astype(object) * n - np.array(sums, object)
    return np.array([[x / n for x in row] for row in d]), (d**2).sum(axis=1).tolist()


def _project(n: int, sums: list[int], axes: np.ndarray, kept: np.ndarray):
    """Rows with `deviation` and an array of whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows, exact = _centred(whole_numbers(part.column(1)), n, sums)
                flat = (rows @ axes).ravel()
                values = pa.array(flat, mask=np.tile(~kept, len(rows)))
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, axes.shape[1], dtype=np.int32), values)
                digits = pa.array([Decimal(x) if x < 10**38 else None for x in exact], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), digits, lists], ["id", "deviation", "white"])

    return run


def _spread(width: int):
    """Of one task: rows, sums and products of whitened components, about the task's own mean, and the mean's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = batch.column(0).flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
            if not len(w):
                continue
            own = w.mean(axis=0)
            total, apart = n + len(w), own - mean
            spread += (w - own).T @ (w - own) + np.outer(apart, apart) * n * len(w) / total
            n, mean = total, mean + apart * len(w) / total
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(n * mean).tolist()]), pa.array([(spread + n * np.outer(mean, mean)).ravel().tolist()])], ["n", "sums", "products"])

    return run


def identity_error(rows: DataFrame, kept: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of the arrays in `white`, of the kept places, less the identity."""
    width = len(kept)
    if not kept.any():
        return None
    parts = rows.select("white").mapInArrow(_spread(width), "n long, sums array<double>, products array<double>")
    cells = parts.select("n", F.posexplode(F.concat("sums", "products")).alias("cell", "x")).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    n, flat = cells[0].n, np.zeros(width + width * width)
    for r in cells:
        flat[r.cell] = r.x
    mean = flat[:width] / n
    cov = flat[width:].reshape(width, width) / n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(width))[np.ix_(kept, kept)].max())


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:  # noqa: A002
    """(id, vector) of rows whose vector has finite entries only."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id).alias("id"), v.alias("vector")).filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(finite)


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:  # noqa: A002
    """One row (id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    rows = usable(vectors, id, vector)
    spark = vectors.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], f"`{id}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    dim = lengths.dim
    rows = rows.filter(F.size("vector") == dim)
    n, sums, centred = scatter(rows.select("vector"), dim)
    values, axes, trace = decompose(n, centred)
    width = min(components, dim)
    kept = values[:width] > max(values[0], 0.0) * dim * 2.0**-52
    scaled = axes[:, :width] / np.where(kept, np.sqrt(np.where(kept, values[:width], 1.0)), 1.0)
    projected = rows.mapInArrow(_project(n, sums, scaled, kept), f"id {kind}, deviation decimal(38,0), white array<double>")
    error = identity_error(projected, kept)
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values[:width]])
    out = projected.select(F.col("id").alias(id), "deviation", F.posexplode("white").alias("at", "whitened"))
    return out.select(id, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def report(vectors: DataFrame) -> DataFrame:
    """whiten() with deviation as a long; null where it is beyond one."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
