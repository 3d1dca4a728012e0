"""Encoders with a phase, random features, controls, replicated studies, observability, bounded descent.

What is fitted comes from sums over all training rows; what is applied to rows is
column expressions, or matrix products of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from . import kernel, metrics, selection, statistics

#: Fixed value: the coordinate that holds a phase.
PHASE = 1
MU0_4PI = 1e-7


def phase_direct(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `x`: scaled angles of all columns, the phase's replaced by the phase itself, wrapped to [-pi, pi)."""
    m = statistics.standardiser(rows, columns).first()
    each = [scalar.angle(F.col(c), F.lit(m[f"{c}_mean"]), F.lit(m[f"{c}_sd"])) for c in columns]
    each[PHASE] = scalar.wrap_phase(F.col(columns[PHASE]))
    return rows.withColumn("x", F.array(*each))


def frequencies(inputs: int, n: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (n, inputs) and offsets (n) of random features of a Gaussian kernel exp(-gamma d^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (n, inputs)), rng.uniform(0, 2 * np.pi, n)


def random_features(x: Column, directions: np.ndarray, offsets: np.ndarray) -> Column:
    """array of sqrt(2/n) cos(w.x + b) of an array column: dot products of it approximate the kernel.

    A batch's rows are one matrix product.  An array that lacks a coordinate has null features, a null array none.
    """
    n, inputs = directions.shape
    scale, turned = float(np.sqrt(2 / n)), np.ascontiguousarray(directions.T)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def features(column: pa.Array) -> pa.Array:
        there, lengths = column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy()
        whole = there & (lengths == inputs)
        held = column.filter(pa.array(whole)).flatten()
        known = held.is_valid().to_numpy(zero_copy_only=False).reshape(-1, inputs).all(axis=1)
        z = np.cos(held.to_numpy(zero_copy_only=False).astype(float).reshape(-1, inputs) @ turned + offsets) * scale
        lacking = np.ones(len(column), bool)
        lacking[np.flatnonzero(whole)[known]] = False
        if not lacking.any():
            return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * n, pa.int32()), pa.array(z.ravel()))
        rows = iter(z[known].tolist())
        return pa.array([None if not t else [None] * n if lacks else next(rows) for t, lacks in zip(there, lacking, strict=True)], pa.list_(pa.float64()))

    return features(x.cast("array<double>"))


def positive_control(rows: DataFrame, id: str, x: str, prototypes: list[tuple[int, list[float]]], gamma: float, n: int) -> DataFrame:  # noqa: A002
    """(id, label, score, place): labels from the kernel's contrast to two prototypes, the n/2 clearest of each."""
    a, b = (kernel.rbf(F.col(x), F.lit(p), gamma) for _, p in prototypes)
    contrast = rows.select(id, (a - b).alias("score")).withColumn("label", F.when(F.col("score") >= 0, 1).otherwise(-1))
    return selection.strongest(contrast, "label", "score", n // 2, id)


def replicated_study(rows: DataFrame, id: str, x: str, label: str, replicas: int, seed: int, methods: dict[str, Column], permute: bool = False) -> DataFrame:  # noqa: A002
    """(replica, method, n, balanced_accuracy, macro_f1): nearest class mean over encodings of all rows, for seeded splits.

    Each replica draws its own three quarters for training by a hash of the id.  methods: name and encoding (an array
    column).  permute: the negative control, whose training labels are drawn by another hash.  Class means are grouped
    sums; a row is scored against the few means of its replica and method.
    """
    lot = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{k}"), "replica", F.col(id).cast("string"))), 1, 8), 16, 10).cast("long")
    each = F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))
    encoded = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), v.alias("z")) for m, v in methods.items()]))
    long = rows.select(id, F.col(label).cast("string").alias("truth"), x, each.alias("replica")).withColumn("train", F.pmod(lot("s"), F.lit(4)) < 3).withColumn("m", encoded).select(id, "truth", "replica", "train", "m.method", "m.z")
    told = F.pmod(lot("p"), F.lit(2)).cast("string") if permute else F.col("truth")
    places = long.filter("train").withColumn("told", told).select("replica", "method", "told", F.posexplode("z").alias("i", "v"))
    coordinate = places.groupBy("replica", "method", "told", "i").agg(F.avg("v").alias("v"))
    centre = coordinate.groupBy("replica", "method", "told").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("c"))
    centres = centre.groupBy("replica", "method").agg(F.array_sort(F.collect_list(F.struct(F.col("told").alias("label"), "c"))).alias("all"))
    far = lambda c: F.aggregate(F.zip_with("z", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    nearest = F.array_min(F.transform("all", lambda c: F.struct(F.round(far(c["c"]), 9).alias("d"), c["label"].alias("label"))))["label"]
    said = long.filter("not train").join(F.broadcast(centres), ["replica", "method"]).withColumn("said", nearest)
    return metrics.scores(said, "truth", "said", ["replica", "method"])


def descend(rows: DataFrame, x: str, y: str, steps: int, rate: float, cap: float, stop: float = 1e-6, start: list[float] | None = None) -> tuple[np.ndarray, list[tuple[int, float, float, str]]]:
    """Weights and history (step, loss, step's length, state) of logistic gradient descent over all rows.

    start: weights to go on from, else zeros.  A step's length is held to `cap`; it ends after `steps`, or when the gradient is shorter than `stop`.  Each step is
    one pass of partial sums.
    """
    first = rows.select(F.size(x).alias("d")).first()
    w, history = np.zeros(first.d if first else 0) if start is None else np.array(start, float), []
    for k in range(steps):

        def part(batches: Iterator[pd.DataFrame], w: np.ndarray = w) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v, t = np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy(float)
                    z = v @ w
                    loss = (np.logaddexp(0, z) - t * z).sum()
                    g = v.T @ (1 / (1 + np.exp(-np.clip(z, -709, 709))) - t)
                    yield pd.DataFrame({"k": np.arange(len(g) + 2), "v": [len(v), loss, *g]})

        sums = rows.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y")).mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        if not sums:
            break
        n, loss, g = sums[0].v, sums[1].v, np.array([r.v for r in sums[2:]])
        step = rate * g / n
        length = float(np.sqrt(step @ step))
        if length > cap:
            step, length = step * (cap / length), cap
        state = "converged" if np.sqrt(g @ g) / n < stop else "budget" if k == steps - 1 else "running"
        w = w - step
        history.append((k, float(loss / n), length, state))
        if state == "converged":
            break
    return w, history


OBSERVED = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("condition", T.DoubleType()), T.StructField("singular", T.ArrayType(T.DoubleType()))])


def _dipole(at: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Fields (n, 3) at n places of a dipole given as position and moment."""
    d = at - source[:3]
    r = np.linalg.norm(d, axis=1, keepdims=True)
    u = d / r
    return MU0_4PI * (3 * u * (u @ source[3:])[:, None] - source[3:]) / r**3


@F.pandas_udf(OBSERVED)
def observability(nodes: pd.Series, source: pd.Series, noise: pd.Series, steps: pd.Series) -> pd.DataFrame:
    """How well a network sees a dipole: rank, condition and singular values of the noise-whitened Jacobian.

    nodes: array of positions; source: position and moment; noise: one deviation per node; steps: of the central
    differences, one for each of the six parameters, by which the Jacobian's columns are scaled too.
    """
    out = []
    for n, s, e, h in zip(nodes, source, noise, steps, strict=True):
        at, s, h = np.stack([np.asarray(p, float) for p in n]), np.asarray(s, float), np.asarray(h, float)
        up, down = (np.stack([_dipole(at, s + sign * h * np.eye(6)[k]).ravel() for k in range(6)], axis=1) for sign in (1, -1))
        jacobian = (up - down) / 2 / np.repeat(np.asarray(e, float), 3)[:, None]
        w = np.linalg.svd(jacobian, compute_uv=False)
        rank = int((w > w[0] * max(jacobian.shape) * np.finfo(float).eps).sum()) if w[0] > 0 else 0
        out.append((rank, float(w[0] / w[-1]) if rank == 6 else None, w.tolist()))
    return pd.DataFrame(out, columns=OBSERVED.names)
