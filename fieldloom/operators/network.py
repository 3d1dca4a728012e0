"""A fitted network as one expression, and a fit that says whether it converged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import let
from .kernel import dot


@dataclass(frozen=True)
class Network:
    """Layers (weights by output and input, offsets) with logistic units between them and softmax behind the last.

    centre, spread: what inputs are standardised by.
    """

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    centre: np.ndarray
    spread: np.ndarray
    iterations: int
    converged: bool

    def scores(self, x: Column) -> Column:
        """Class probabilities of an array column, without a Python worker."""
        out = F.zip_with(x, F.lit([[float(m), float(s)] for m, s in zip(self.centre, self.spread, strict=True)]), lambda v, p: (v - F.get(p, F.lit(0))) / F.get(p, F.lit(1)))
        for w, b in self.layers[:-1]:
            out = _layer(out, w, b, lambda z: 1 / (1 + F.exp(-z)))
        out = _layer(out, *self.layers[-1], lambda z: z)

        def softmax(z: Column) -> Column:
            e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
            return let(e, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u)))

        return let(out, softmax)


def _layer(x: Column, w: np.ndarray, b: np.ndarray, unit: Callable[[Column], Column]) -> Column:
    rows = F.lit(np.column_stack([w, b]).tolist())
    return let(F.concat(x, F.array(F.lit(1.0))), lambda a: F.transform(rows, lambda r: unit(dot(a, r))))


def fit(rows: DataFrame, x: str, y: str, hidden: list[int], iterations: int, seed: int, tolerance: float = 1e-4) -> Network:
    """A network of all rows; y holds the classes 0, 1, ...  Inputs are standardised by the rows' own moments."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    m = rows.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()  # a row for each input
    centre, spread = np.array([r.m for r in m]), np.array([r.s if r.s and r.s > 1e-12 else 1.0 for r in m])
    scaled = F.zip_with(x, F.lit([[float(a), float(b)] for a, b in zip(centre, spread, strict=True)]), lambda v, p: (v - F.get(p, F.lit(0))) / F.get(p, F.lit(1)))
    classes = rows.agg((F.max(y) + 1).alias("n")).first().n
    sizes = [len(m), *hidden, int(classes)]
    ready = rows.select(array_to_vector(scaled).alias("features"), F.col(y).cast("double").alias("label"))
    model = MultilayerPerceptronClassifier(layers=sizes, maxIter=iterations, tol=tolerance, seed=seed).fit(ready)
    flat, at, layers = model.weights.toArray(), 0, []
    for a, b in zip(sizes, sizes[1:]):
        layers.append((flat[at : at + a * b].reshape(a, b).T.copy(), flat[at + a * b : at + a * b + b].copy()))
        at += a * b + b
    losses = list(model.summary().objectiveHistory)
    steady = len(losses) > 1 and abs(losses[-1] - losses[-2]) <= tolerance * max(abs(losses[-2]), 1.0)
    return Network(tuple(layers), centre, spread, len(losses) - 1, bool(steady and np.isfinite(flat).all()))
