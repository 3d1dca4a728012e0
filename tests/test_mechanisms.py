"""Scans, latches, streams with state, grids and resampling against plain Python."""

import random
import time

import numpy as np
import pytest
from fieldloom import registry  # noqa: F401  (plans register themselves through it)
from fieldloom.operators import grid, joins, resampling, scans
from fieldloom.plans import frames as frame_plans
from fieldloom.streaming import state8 as stream
from pyspark.sql import functions as F


@pytest.fixture
def finely(spark):
    """Many partitions and short Arrow batches, so that series cross both."""
    keys = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scans_along_series_over_many_partitions(spark, finely):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, None, rng.random() * 10]), rng.choice([None, f"x{i}"]), rng.randrange(5)) for k, n in (("a", 300), ("b", 1), (None, 40), ("c", 3), ("d", 90)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, x double, s string, n int")
    half = F.when(F.col("x").isNotNull(), F.lit(0.5))
    out = scans.scan(df, ["k"], ["i"], carry={"c": F.col("s")}, lag={"l": F.col("s")}, sums={"t": F.col("n"), "tx": F.col("x")}, affine={"y": (half, F.col("x") * 0.5, F.lit(3.0))}).collect()
    got = {(r.k, r.i): r for r in out}
    assert len(out) == len(rows)
    for k in {r[0] for r in rows}:
        c = last = None
        t, tx, y = 0, 0.0, 3.0
        for _, i, x, s, n in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            g = got[k, i]
            assert g.l == last
            c, t, tx, y, last = s if s is not None else c, t + n, tx + (x or 0), y if x is None else 0.5 * y + 0.5 * x, s
            assert (g.c, g.t) == (c, t) and g.tx == pytest.approx(tx) and g.y == pytest.approx(y)
    assert scans.scan(df.filter("false"), ["k"], ["i"], sums={"t": F.col("n")}).count() == 0


def test_a_value_that_is_not_finite_stays_in_its_series(spark, finely):
    rows = [("a", i, 1e308 if i < 5 else 1.0) for i in range(30)] + [("b", i, 1.0) for i in range(30)]
    out = scans.scan(spark.createDataFrame(rows, "k string, i int, x double"), ["k"], ["i"], sums={"t": F.col("x")}).collect()
    assert all(r.t == r.i + 1 for r in out if r.k == "b") and max(r.t for r in out if r.k == "a") == float("inf")


def test_latches_follow_the_first_trigger(spark, finely):
    rng = random.Random(3)
    rows = [(k, i, t) for k, n in (("a", 150), ("b", 1), (None, 30)) for i, t in enumerate(sorted(rng.randrange(300) for _ in range(n)))]
    want = set()
    for k in ("a", "b", None):
        until = -1e9
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if t >= until:
                want.add((k, i, t + 10.0))
                until = t + 10
    rng.shuffle(rows)
    got = scans.latches(spark.createDataFrame(rows, "k string, id int, t int"), ["k"], "t", "id", 10).collect()
    assert {(r.k, r.id, r.until) for r in got} == want and len(got) == len(want)


def test_overlaps_of_a_thousand_groups(spark, finely):
    rng = random.Random(4)
    spans = [(rng.choice("ab"), i, a := rng.randrange(4000), a + rng.randrange(1, 40), f"g{rng.randrange(1000)}") for i in range(1200)]
    df = spark.createDataFrame(spans, "k string, id int, a int, b int, g string")
    want = {(x[0], x[1], y[1]) for x in spans for y in spans if x[0] == y[0] and x[4] != y[4] and (x[2], x[1]) < (y[2], y[1]) and x[3] > y[2]}
    assert {tuple(r) for r in joins.overlap_pairs(df, "k", "id", "a", "b", "g", 20.0).collect()} == want
    reach = {(x[0], y[1]): 0 for x in spans for y in spans if (x[0], x[1], y[1]) in want}
    assert {(r.k, r.id) for r in joins.overlaps(df, "k", "id", "a", "b", "g").collect()} == set(reach)


# streams


def delivered(spark, n, session="s", version=1, first=1, lose=()):
    rng = np.random.default_rng(5)
    value = rng.normal(50, 5, (n, 2))
    rows = [(session, version, i + first, (i + first - 1) / 10.0, [float(v) for v in value[i]]) for i in range(n) if i not in lose]
    df = spark.createDataFrame(rows, "session_id string, configuration_version int, frame_id long, sim_time_s double, v array<double>")
    each = F.transform("v", lambda v, k: frame_plans.reading(F.concat(F.lit("n"), k.cast("string")), F.col("frame_id"), v, F.lit(1)))
    return df.withColumn("readings", each).drop("v")


def test_stream_fences_versions_and_starts_over(spark, tmp_path):
    go = lambda df: stream.arrive(df, f"{tmp_path}/in", f"{tmp_path}/ck", f"{tmp_path}/out", first=80, size=40, hop=20, hz=10.0)
    go(delivered(spark, 130))
    go(delivered(spark, 20, first=131).unionByName(delivered(spark, 60, version=2)))  # the new version ends the old one
    go(delivered(spark, 70, version=2, first=61).unionByName(delivered(spark, 5, first=151)))  # frames of the old one are dropped
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.epoch, r.start, r.skipped) for r in out} == {(0, 80, 0), (1, 80, 0)} and {r.sensor_id for r in out} == {"n0", "n1"}
    assert {r.fenced for r in out if r.epoch == 1} == {5} and all(r.valid and r.f7 == 1.0 for r in out)


def test_stream_goes_on_from_a_known_reference(spark, tmp_path):
    own = stream.stateful(spark)
    delivered(spark, 60, first=201).write.parquet(f"{tmp_path}/in")
    begin = own.createDataFrame([("s", 1, 200, ["n0", "n1"], [50.0, 50.0], [290.5, 290.5], ["v1", "v1"])], stream.INITIAL)
    source = own.readStream.schema(own.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = stream.analyse(source, begin, first=80, size=40, hop=20, hz=10.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.start, r.sensor_id, r.valid) for r in out} == {(220, "n0", True), (220, "n1", True)}


def test_an_idle_session_says_so(spark, tmp_path):
    own = stream.stateful(spark)
    delivered(spark, 10).write.parquet(f"{tmp_path}/in")
    source = own.readStream.schema(own.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = stream.analyse(source, first=80, size=40, hop=20, hz=10.0, idle_s=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if own.table("idle").count():
                break
        assert [(r.session_id, r.status) for r in own.table("idle").collect()] == [("s", "idle")]
    finally:
        q.stop()


# fits


def test_grid_reaches_each_candidates_least_loss(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = np.where(x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=400) > 0, 1, -1)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int").repartition(5)
    maps, costs = [grid.raw(), *[grid.gaussian(5, 64, g, 1) for g in (0.1, 1.0)], grid.landmarks(x[:12], 0.5)], [0.1, 10.0]
    weights, history = grid.fit(df, "x", "y", maps, costs)
    assert {h[:3] for h in history if h[-1] == "converged"} == {(m.method, c, m.gamma) for m in maps for c in costs}
    for (m, c), w in weights.items():
        z = maps[m](x)
        slope = w - 2 * costs[c] * z.T @ (np.maximum(0, 1 - y * (z @ w)) * y)
        assert np.abs(slope).max() < 1e-5
    decided = grid.decide(df.withColumn("split", F.lit("VALIDATION")), "x", maps, costs, weights)
    assert decided.count() == 400 * 8
    best = {r.method: r for r in grid.chosen(grid.judged(decided, "y", "VALIDATION")).collect()}
    assert best["rbf"].balanced_accuracy > best["linear"].balanced_accuracy + 0.15
    assert grid.fit(df.filter("false"), "x", "y", maps, costs) == ({}, [])


def test_a_step_that_does_not_lower_the_loss_is_halved(spark):
    x = [[1e4], [1.0], [-1.0], [0.5]] * 3
    df = spark.createDataFrame(list(zip(x, [1, -1, 1, -1] * 3)), "x array<double>, y int")
    weights, history = grid.fit(df, "x", "y", [grid.raw()], [10.0])
    losses = [h[4] for h in history if h[-1] != "halved"]
    assert history[-1][-1] == "converged" and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))


def exact_auc(p, s, w):
    up, down = w[p], w[~p]
    order = (s[p][:, None] > s[~p][None, :]) + 0.5 * (s[p][:, None] == s[~p][None, :])
    return up @ order @ down / (up.sum() * down.sum())


def test_poisson_bootstrap(spark, finely, monkeypatch):
    rng = np.random.default_rng(1)
    n = 700
    p = rng.random(n) < 0.3
    s = np.round(rng.normal(size=n) + p, 1)  # many ties
    rows = list(zip(range(n), p.tolist(), s.tolist()))
    df = spark.createDataFrame(rows, "id long, p boolean, s double")
    w = resampling.counts(np.arange(n), 100, 7)
    got = resampling.aucs(df, "id", F.col("p"), "s", 100, 7)
    assert got == pytest.approx([exact_auc(p, s, w[:, k]) for k in range(101)], abs=1e-12)
    assert resampling.aucs(df.repartition(3), "id", F.col("p"), "s", 100, 7) == pytest.approx(got, abs=1e-12)
    want = [np.quantile(np.repeat(s, w[:, k].astype(int)), 0.5) for k in range(101)]
    assert resampling.quantiles(df, "id", "s", 0.5, 100, 7) == pytest.approx(want)
    monkeypatch.setattr(resampling, "LAST", 20)
    assert resampling.quantiles(df, "id", "s", 0.5, 100, 7) == pytest.approx(want)
    assert w[:, 1:].mean() == pytest.approx(1, abs=0.02) and w[:, 1:].var() == pytest.approx(1, abs=0.05)
    # As wide as by drawing rows.
    draws = [exact_auc(p[i], s[i], np.ones(n)) for i in (rng.integers(0, n, n) for _ in range(400))]
    low, high = resampling.interval(resampling.aucs(df, "id", F.col("p"), "s", 400, 7))[1:3]
    assert (low, high) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=0.02)
    assert np.isnan(resampling.aucs(df.filter("p"), "id", F.col("p"), "s", 3)).all() and np.isnan(resampling.quantiles(df.filter("false"), "id", "s", 0.5, 3)).all()


def test_partitions_of_a_stream_state_are_bounded_by_cores(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for given, most in (("200", 2 * spark.sparkContext.defaultParallelism), ("3", 3)):
            spark.conf.set("spark.sql.shuffle.partitions", given)
            assert int(stream.stateful(spark).conf.get("spark.sql.shuffle.partitions")) == most
            assert spark.conf.get("spark.sql.shuffle.partitions") == given
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
