"""Grids of kernel machines, all candidates fitted together.

A feature map turns rows into coordinates whose dot products are (or approximate) a
kernel: random features of a Gaussian kernel, coordinates among landmarks, or the row
itself.  A candidate is a map and a cost.  Its machine minimises

    |w|^2 / 2 + cost * sum of max(0, 1 - y w.z)^2

(a constant coordinate is the offset) by Newton's method.  One pass over the rows gives
loss, gradient and second derivatives of every candidate that hasn't converged: a map
is worked out once per batch whatever the number of its costs, tasks leave sums, sums
are added up by row of the matrix, and the driver solves one system per candidate.  A
step that doesn't lower the loss is halved.  Passes don't depend on the grid's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .kernel import basis

PASSES, STOP, DECREASE = 40, 1e-9, 1e-4
#: Rows at once.
RUN = 2048


@dataclass(frozen=True)
class FeatureMap:
    """A method's map; gamma is what its candidates are told apart by."""

    method: str
    gamma: float
    make: Callable[[np.ndarray], np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.make(x), np.ones(len(x))])


def raw(method: str = "linear") -> FeatureMap:
    return FeatureMap(method, 0.0, lambda x: x)


def gaussian(inputs: int, n: int, gamma: float, seed: int, method: str = "rbf") -> FeatureMap:
    """n random features of exp(-gamma d^2); maps of one seed have the same directions but for their length."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(inputs, n)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, n)
    return FeatureMap(method, gamma, lambda x: np.sqrt(2 / n) * np.cos(x @ w + b))


def landmarks(marks: np.ndarray, gamma: float, method: str = "landmarks") -> FeatureMap:
    """Coordinates among landmarks: the kernel with them, times the regularised inverse root of their own."""

    def near(x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] + (marks * marks).sum(axis=1)[None, :] - 2 * x @ marks.T
        return np.exp(-gamma * np.maximum(d, 0))

    b = basis(near(marks))
    return FeatureMap(method, gamma, lambda x: near(x) @ b)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _passed(maps: list[FeatureMap], costs: list[float], weights: dict[tuple[int, int], np.ndarray]):
    """Of one task: for each open candidate the rows of its second derivatives, and (n, loss, gradient)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                x, y = _matrix(part.column(0)), part.column(1).to_numpy()
                for m, make in enumerate(maps):
                    own = [k for k in weights if k[0] == m]
                    z = make(x) if own else None
                    for k in own:
                        short = np.maximum(0.0, 1 - y * (z @ weights[k]))
                        act = z[short > 0]
                        new = [len(y), float(short @ short), -2 * (z.T @ (short * y)), 2 * (act.T @ act)]
                        sums[k] = [a + b for a, b in zip(sums[k], new, strict=True)] if k in sums else new
        rows = [(m * len(costs) + c, i, v) for (m, c), (n, loss, g, h) in sums.items() for i, v in enumerate([np.array([n, loss, *g]), *h])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["candidate", "i", "v"])

    return run


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the arrays of each (candidate, i); rows of one are in one task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for c, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = v.values.to_numpy()
            sums[c, i] = sums[c, i] + own if (c, i) in sums else own
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["candidate", "i", "v"])


def fit(rows: DataFrame, x: str, y: str, maps: list[FeatureMap], costs: list[float], passes: int = PASSES, stop: float = STOP) -> tuple[dict[tuple[int, int], np.ndarray], list[tuple]]:
    """Weights by (map, cost) numbers, and a history (method, cost, gamma, step, loss, slope, state) of every pass.

    y is -1 or 1.  A candidate ends when its gradient is `stop` of its first one; one that doesn't within `passes` says so.
    """
    made = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    first = made.select(F.size("x").alias("d")).first()
    if first is None:
        return {}, []
    keys = [(m, c) for m in range(len(maps)) for c in range(len(costs))]
    at = {k: np.zeros(maps[k[0]](np.zeros((1, first.d))).shape[1]) for k in keys}
    base: dict[tuple[int, int], tuple] = {}  # weights, loss and step of the last accepted point
    scale: dict[tuple[int, int], float] = {}
    open_, history = set(keys), []
    for step in range(passes):
        sums: dict[tuple[int, int], dict[int, np.ndarray]] = {k: {} for k in open_}
        partial = made.mapInArrow(_passed(maps, costs, {k: at[k] for k in open_}), "candidate int, i int, v array<double>")
        for r in partial.repartition("candidate", "i").mapInArrow(added, "candidate int, i int, v array<double>").toLocalIterator():
            sums[divmod(r.candidate, len(costs))][r.i] = np.array(r.v)
        for k in sorted(open_):
            w, cost, own = at[k], costs[k[1]], sums[k]
            loss, slope = w @ w / 2 + cost * own[0][1], w + cost * own[0][2:]
            size = float(np.sqrt(slope @ slope))
            scale.setdefault(k, size)
            if k in base and loss > base[k][1] + DECREASE * base[k][3] * base[k][4]:
                w0, loss0, d, share, fall = base[k]
                base[k], at[k], state = (w0, loss0, d, share / 2, fall), w0 + share / 2 * d, "halved"
            elif size <= stop * scale[k]:
                state = "converged"
                open_.discard(k)
            else:
                d = np.linalg.solve(np.eye(len(w)) + cost * np.stack([own[i] for i in range(1, len(w) + 1)]), -slope)
                base[k], at[k], state = (w, loss, d, 1.0, float(slope @ d)), w + d, "open"
            history.append((maps[k[0]].method, costs[k[1]], maps[k[0]].gamma, step, float(loss), size, state))
        if not open_:
            break
    return at, history


def decide(rows: DataFrame, x: str, maps: list[FeatureMap], costs: list[float], weights: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """rows (without x) for each candidate, with method, cost, gamma, score and said (-1 or 1); a map is worked out once a row."""
    kept = [c for c in rows.columns if c != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                v = _matrix(part.column(part.num_columns - 1))
                score = np.column_stack([z @ weights[m, c] for m, z in enumerate(make(v) for make in maps) for c in range(len(costs))])
                lists = pa.ListArray.from_arrays(np.arange(0, score.size + 1, score.shape[1], dtype=np.int32), score.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*kept, "scores"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    scored = rows.select(*kept, F.col(x).cast("array<double>").alias("x")).mapInArrow(run, f"{kinds}, scores array<double>")
    names = F.array(*[F.struct(F.lit(m.method).alias("method"), F.lit(float(c)).alias("cost"), F.lit(m.gamma).alias("gamma")) for m in maps for c in costs])
    each = scored.select(*kept, F.explode(F.arrays_zip(names.alias("of"), F.col("scores").alias("score"))).alias("e"))
    return each.select(*kept, "e.of.*", "e.score").withColumn("said", F.when(F.col("score") >= 0, 1).otherwise(-1))


BY = ["method", "cost", "gamma"]


def judged(decided: DataFrame, truth: str, split: str) -> DataFrame:
    """n, balanced accuracy and macro F1 of each candidate on one split."""
    rows = decided.filter(F.col("split") == split).select(*BY, F.col(truth).cast("string").alias("t"), F.col("said").cast("string").alias("p"))
    return metrics.scores(rows, "t", "p", BY)


def chosen(validated: DataFrame) -> DataFrame:
    """The best candidate of each method: by balanced accuracy, macro F1, then the least cost and gamma."""
    return metrics.best(validated, ["method"], F.desc(F.round("balanced_accuracy", 12)), F.desc(F.round("macro_f1", 12)), "cost", "gamma")


def intervals(decided: DataFrame, truth: str, replicates: int, seed: int) -> DataFrame:
    """(method, low, high): percentile interval of balanced accuracy over stratified resamples of the TEST rows, from counts.

    All methods' draws are of the same replicates.
    """
    rows = decided.filter("split = 'TEST'")
    stratum = F.concat_ws(":", "method", F.col(truth).cast("string"))
    cells = rows.groupBy(stratum.alias("stratum"), (F.col(truth) == F.col("said")).cast("int").alias("hit")).agg(F.count("*").alias("n"))
    drawn = metrics.bootstrap(cells, "stratum", "hit", replicates, seed).groupBy("replicate", "stratum").agg((F.sum(F.col("hit") * F.col("n")) / F.sum("n")).alias("recall"))
    each = drawn.groupBy("replicate", F.substring_index("stratum", ":", 1).alias("method")).agg(F.avg("recall").alias("ba"))
    return metrics.interval(each, "ba", ["method"]).drop("replicates")
