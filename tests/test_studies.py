"""Studies and gates: what they must show on data that is made for it."""

import numpy as np
import pytest
from fieldloom import registry
from fieldloom.functions import geometry as G
from fieldloom.operators import evaluation, studies
from pyspark.sql import functions as F


def test_observability(spark):
    places = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 1.0, 0.4]]
    rows = [(name, n, [0.5, 0.4, 2.0, 0.3, 0.2, 1.0], [e] * len(n), [1e-3] * 6) for name, n, e in (("one", places[:1], 1e-10), ("four", places, 1e-10), ("noisy", places, 2e-10))]
    nets = spark.createDataFrame(rows, "network string, nodes array<array<double>>, source array<double>, noise array<double>, steps array<double>")
    r = {x.network: x.o for x in nets.select("network", studies.observability("nodes", "source", "noise", "steps").alias("o")).collect()}
    assert r["one"].rank <= 3 and r["one"].condition is None
    assert r["four"].rank == 6 and abs(r["four"].condition / r["noisy"].condition - 1) < 1e-6
    assert np.allclose(np.array(r["four"].singular), 2 * np.array(r["noisy"].singular))


def test_random_features_approximate_the_kernel(spark):
    w, b = studies.frequencies(3, 600, 0.5, 1)
    rows = spark.createDataFrame([([0.1, 0.2, 0.3],), ([0.4, -0.1, 0.2],), ([2.0, 1.0, -1.0],)], "x array<double>")
    z = np.array([r.z for r in rows.select(studies.random_features(F.col("x"), w, b).alias("z")).collect()])
    x = np.array([r.x for r in rows.collect()])
    want = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.15


def test_random_features_are_matrix_products_of_batches(spark):
    w, b = studies.frequencies(3, 5, 0.5, 1)
    x = [[0.1 * i, -0.2, 0.3 * i] for i in range(40)]
    odd = [(40, None), (41, [1.0, None, 2.0]), (42, [1.0, 2.0]), (43, [])]
    df = spark.createDataFrame([*enumerate(x), *odd], "id int, x array<double>").repartition(3)
    z = df.select("id", studies.random_features(F.col("x"), w, b).alias("z"))
    plan = z._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
    got = {r.id: r.z for r in z.collect()}
    assert np.allclose([got[i] for i in range(40)], np.sqrt(2 / 5) * np.cos(np.array(x) @ w.T + b), atol=1e-12)
    assert got[40] is None and all(got[i] == [None] * 5 for i in (41, 42, 43))


def test_studies_tell_signal_from_chance(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4) + (i % 2)], i % 2) for i in range(600)], "id long, x array<double>, y int")
    real, none = (studies.replicated_study(rows, "id", "x", "y", 3, 5, {"raw": F.col("x")}, permute).collect() for permute in (False, True))
    assert all(r.balanced_accuracy > 0.8 for r in real) and abs(np.mean([r.balanced_accuracy for r in none]) - 0.5) < 0.12


def test_descent_lowers_the_loss_and_says_why_it_stops(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0).astype(int)
    rows = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x array<double>, y int")
    w, history = studies.descend(rows, "x", "y", 6, 4.0, 0.5)
    losses, lengths = [h[1] for h in history], [h[2] for h in history]
    assert all(a > b for a, b in zip(losses, losses[1:])) and max(lengths) <= 0.5 + 1e-12 and history[-1][3] == "budget" and w[1] < 0 < w[0]
    assert studies.descend(rows, "x", "y", 9, 1.0, 1.0, stop=9.0)[1][-1][3] == "converged" and studies.descend(rows.filter("false"), "x", "y", 3, 1.0, 1.0) [1] == []


def test_gates(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("a", 2, True), ("b", 3, False), ("b", 4, True), ("b", 4, True)], "c string, e int, ok boolean")
    got = {r.c: (r.n, r.retained, r.lost_episodes, r.passes) for r in evaluation.pilot_gate(rows, "c", "e", F.col("ok")).collect()}
    assert got == {"a": (3, 3, 0, True), "b": (3, 2, 1, False)}
    p = spark.createDataFrame([([0.9, 0.1], False, True), ([0.5, 0.5], False, True), ([0.9, 0.1], True, True), ([0.9, 0.1], False, None), (None, False, True)], "s array<double>, ood boolean, ok boolean")
    said = [r.displayed for r in evaluation.predict(p, F.col("s"), ["x", "y"], F.col("ood"), F.col("ok")).collect()]
    assert said == ["x"] + ["ABSTAIN"] * 4


def test_orientation(spark):
    q = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    row = spark.range(1).select(G.integrate(q(1, 0, 0, 0), q(0, 0, np.pi / 2), 1.0).alias("z"), G.integrate(q(1, 0, 0, 0), q(0, 0, 0), 1.0).alias("still"), G.project(q(3, 0, 4), "total").alias("t"), G.project(q(3, 0, 4), "vector").alias("v")).first()
    tilted = spark.range(1).select(G.integrate(q(0.5, 0.5, 0.5, 0.5), q(1, 0, 0), 1.0).alias("q")).first().q
    assert tilted == pytest.approx([0.19907, 0.678504, 0.19907, 0.678504], abs=1e-5)
    assert row.z == pytest.approx([np.sqrt(0.5), 0, 0, np.sqrt(0.5)]) and row.still == [1, 0, 0, 0] and row.t == [5] and row.v == [3, 0, 4]


def test_learners_score_all_rows(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for name in ("mlp_score", "kernel_machine", "boosted_trees"):
        rows = registry.QUERIES[name](spark, sf_dir).collect()
        train = [r for r in rows if r.split == "TRAIN"]
        assert len(rows) == n and {r.split for r in rows} == {"TRAIN", "VALIDATION", "TEST"} and sum(r.said == r.y for r in train) > 0.6 * len(train)
