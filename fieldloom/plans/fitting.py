"""Queries that fit: grids of kernel machines, and intervals of statistics that are no sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, resampling, runs, selection, spectrum
from ..registry import query
from ..shared import shared_folder, stored
from ..sources.tables import table
from .models import _V, GAMMA, WIDTH, _marks, vectors

COSTS, GAMMAS, FEATURES = [0.1, 1.0, 10.0], [0.05, 0.5, 5.0], 256


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple]]:
    """Decisions of all candidates on all rows: linear, Gaussian (3 x 3) and landmark machines (3), fitted on TRAIN together."""
    rows = vectors(spark, sf_dir).withColumn("y", F.when(F.col("label") < 5, -1).otherwise(1))
    split = stored(selection.lineage_split(rows, "vec_id", "y", 5))
    marks = np.array([m for _, m in _marks(rows)])
    maps = [grid.raw(), *[grid.gaussian(WIDTH, FEATURES, g, 9) for g in GAMMAS], grid.landmarks(marks, GAMMA)]
    weights, history = grid.fit(split.filter("split = 'TRAIN'"), "x", "y", maps, COSTS)
    return grid.decide(split.select("vec_id", "y", "split", "x"), "x", maps, COSTS, weights), history


@query()
def machine_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's scores on VALIDATION, whether it converged, and whether its method takes it."""
    decided, history = _fitted(spark, sf_dir)
    validated = stored(grid.judged(stored(decided), "y", "VALIDATION"))
    ended = spark.createDataFrame([(m, c, g) for m, c, g, *_, state in history if state == "converged"], "method string, cost double, gamma double").withColumn("converged", F.lit(True))
    best = grid.chosen(validated).select(*grid.BY, F.lit(True).alias("taken"))
    return validated.join(F.broadcast(ended), grid.BY, "left").join(F.broadcast(best), grid.BY, "left").na.fill(False)


@query()
def machine_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taken candidate of each method, once on TEST, with an interval over resamples."""
    decided = stored(_fitted(spark, sf_dir)[0])
    frozen = stored(grid.chosen(grid.judged(decided, "y", "VALIDATION")).select(*grid.BY))
    once = stored(decided.filter("split = 'TEST'").join(F.broadcast(frozen), grid.BY))
    return grid.judged(once, "y", "TEST").join(F.broadcast(grid.intervals(once, "y", 2000, 13)), "method")


REPLICATES = 200
_COUNTS = " + ".join(f"(h >= {t})::INT" for t in resampling.TABLE)
_ONE = f"xor(h, h >> 16) * {resampling.ROUND} % 4294967296"
_DRAWN = f"""a AS (SELECT event_id, event_type = 'error' AS p, value AS s, r, CASE WHEN r < 0 THEN 0 ELSE (event_id * {resampling.OF_ID} + r * {resampling.OF_REPLICATE} + 3) % 4294967296 END AS h FROM events, (SELECT unnest(range(-1, {REPLICATES})) AS r)),
b AS (SELECT * REPLACE ({_ONE} AS h) FROM a), c AS (SELECT * REPLACE ({_ONE} AS h) FROM b), d AS (SELECT * REPLACE (xor(h, h >> 16) AS h) FROM c),
w AS (SELECT p, s, r, CASE WHEN r < 0 THEN 1 ELSE {_COUNTS} END AS w FROM d)"""
_SAID = "round(max(CASE WHEN r < 0 THEN v END), 8) AS estimate, round(quantile_cont(CASE WHEN r >= 0 THEN v END, 0.025), 8) AS low, round(quantile_cont(CASE WHEN r >= 0 THEN v END, 0.975), 8) AS high, count(CASE WHEN r >= 0 THEN v END) AS replicates"
_AUCS = f"""g AS (SELECT r, s, sum(CASE WHEN p THEN w ELSE 0 END) AS pos, sum(CASE WHEN p THEN 0 ELSE w END) AS neg FROM w GROUP BY r, s),
k AS (SELECT r, pos, neg, sum(neg) OVER (PARTITION BY r ORDER BY s) - neg / 2.0 AS below FROM g), u AS (SELECT r, sum(pos * below) / (sum(pos) * sum(neg)) AS v FROM k GROUP BY r)"""
_MEDIANS = """o AS (SELECT r, s, sum(w) AS w FROM w GROUP BY r, s), q AS (SELECT r, s, sum(w) OVER (PARTITION BY r ORDER BY s) AS upto, w, (sum(w) OVER (PARTITION BY r) - 1) / 2.0 AS place FROM o),
m AS (SELECT r, min(CASE WHEN upto > floor(place) THEN s END) AS x, min(CASE WHEN upto > ceil(place) THEN s END) AS y, any_value(place - floor(place)) AS f FROM q GROUP BY r), n AS (SELECT r, x + (y - x) * f AS v FROM m)"""


@query(f"WITH {_DRAWN}, {_AUCS}, {_MEDIANS} SELECT 'auc' AS statistic, {_SAID} FROM u UNION ALL SELECT 'median', {_SAID} FROM n")
def poisson_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of how well a value tells errors from other events, and of its median."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    found = {"auc": resampling.aucs(e, "event_id", F.col("event_type") == "error", "value", REPLICATES, 3), "median": resampling.quantiles(e, "event_id", "value", 0.5, REPLICATES, 3)}
    said = [(k, *[round(v, 8) for v in resampling.interval(x)[:3]], resampling.interval(x)[3]) for k, x in found.items()]
    return spark.createDataFrame(said, "statistic string, estimate double, low double, high double, replicates long")


@query(f"WITH {_V}, g AS (SELECT a.vec_id AS i, b.vec_id AS j, exp(-{GAMMA} * pow(list_distance(a.x, b.x), 2)) AS k FROM v a, v b) SELECT round(sum(CASE WHEN i = j THEN k END), 4) AS trace, round(sqrt(sum(k * k)), 4) AS frobenius FROM g")
def kernel_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace and norm of the Gaussian kernel of all rows; the norm is from all pairs."""
    n, norm = spectrum.norm(vectors(spark, sf_dir), "vec_id", "x", GAMMA)
    return spark.createDataFrame([(float(n), round(norm, 4)) if n else (None, None)], "trace double, frobenius double")


@query()
def kernel_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 greatest eigenvalues, each with what it is at most, their share of the trace, and the effective rank."""
    r = spectrum.spectrum(vectors(spark, sf_dir), "vec_id", "x", GAMMA, 0.01, 512)
    rows = [(i, float(v), float(v + r["error"]), float(v / r["trace"]), r["effective_rank"], r["pivots"]) for i, v in enumerate(r["eigenvalues"][:32])]
    return spark.createDataFrame(rows, "i long, at_least double, at_most double, share double, effective_rank double, pivots long")


@query()
def resumed_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic descent that ends after three steps and goes on from what it stored."""
    rows = vectors(spark, sf_dir).withColumn("y", F.col("label") % 2)
    folder = shared_folder(spark)
    for steps in (3, 8):
        done, w, ended = runs.descent(runs.Run(spark, folder), rows, "x", "y", steps, 0.5, 0.5)
    return spark.createDataFrame([(i, v, done, ended) for i, v in enumerate(w)], "i long, w double, steps int, ended string")
