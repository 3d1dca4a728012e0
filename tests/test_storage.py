"""Array datasets, strict configurations, portable networks, resumable runs, kernel spectra, lag tables."""

import json
import threading
import time

import numpy as np
import pytest
from fieldloom import registry  # noqa: F401  (plans register themselves through it)
from fieldloom.operators import network, runs, spectrum, studies
from fieldloom.sources import arrays
from fieldloom.sources import configurations as C
from fieldloom.streaming import lag
from pyspark.sql import functions as F


def written(spark, path, n=50):
    rng = np.random.default_rng(0)
    rows = [("TRAIN" if i % 3 else "TEST", i, rng.normal(size=(2, 3)).tolist(), [bool(i % 2), True]) for i in range(n)]
    df = spark.createDataFrame(rows, "split string, row long, x array<array<double>>, mask array<boolean>").repartition(4)
    arrays.write_arrays(df, path)
    return rows


def test_arrays_round_trip_by_split(spark, tmp_path):
    path = f"{tmp_path}/d"
    rows = written(spark, path)
    back = arrays.read_arrays(spark, path)
    assert sorted((r.split, r.row, r.x, r["mask"]) for r in back.collect()) == sorted(rows)
    manifest = json.loads((tmp_path / "d" / "manifest.json").read_text())
    other = next(p for p in manifest["parts"] if p["split"] == "TEST")
    (tmp_path / "d" / other["folder"] / "x.npy").unlink()  # a split that is not asked for is not opened
    assert arrays.read_arrays(spark, path, ["TRAIN"]).count() == sum(r[0] == "TRAIN" for r in rows)
    spark.conf.set(arrays.PUSHES, "true")
    try:
        assert arrays.read_arrays(spark, path).filter("split = 'TRAIN' and row > 10").count() == sum(r[0] == "TRAIN" and r[1] > 10 for r in rows)
    finally:
        spark.conf.unset(arrays.PUSHES)
    with pytest.raises(Exception, match="(?i)no such file|not.?found"):
        arrays.read_arrays(spark, path).count()


def test_arrays_that_changed_or_do_not_fit_fail(spark, tmp_path):
    path = f"{tmp_path}/d"
    written(spark, path)
    with pytest.raises(Exception, match="never overwritten"):
        written(spark, path)
    part = json.loads((tmp_path / "d" / "manifest.json").read_text())["parts"][0]
    file = tmp_path / "d" / part["folder"] / "x.npy"
    np.save(file, np.load(file) + 1)
    with pytest.raises(Exception, match="not what the manifest says"):
        arrays.read_arrays(spark, path).collect()
    ragged = spark.createDataFrame([("A", [1.0]), ("A", [1.0, 2.0])], "split string, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="several shapes"):
        arrays.write_arrays(ragged, f"{tmp_path}/e")
    assert not (tmp_path / "e" / "manifest.json").exists()


def test_recomputed_features(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0]), ([1.0, 2.0], [3.5]), ([1.0, 2.0], [3.0, 1.0])], "x array<double>, f array<double>")
    assert [r.matches for r in arrays.recomputed(df, "f", F.array(F.get("x", F.lit(0)) + F.get("x", F.lit(1)))).collect()] == [True, False, False]


def test_all_faults_of_a_text(spark):
    spec = C.Record({"a": C.Number(0, 9, integer=True), "b": C.Items(C.Record({"c": C.Text(nonempty=True)}), 1, 2, unique="c"), "d": C.Flag(nullable=True)}, optional=("d",))
    rule = C.Rule("a above 5 with two items", lambda v: (C.number(v, "$.a") > 5) & (F.size(F.try_variant_get(v, "$.b", "array<variant>")) > 1))
    cases = {
        '{"a": 1, "b": [{"c": "x"}], "d": null}': [],
        '{"a": 1.5, "b": [], "e": 1}': ["r.a: not an integer", "r.b: wrong number of items", "r.e: unknown"],
        '{"a": 12, "b": [{"c": "x"}, {"c": "x"}]}': ["r.a: out of range", "r.b: repeated c", "r: a above 5 with two items"],
        '{"b": [{"c": " ", "z": 1}, 3], "d": 1}': ["r.a: missing", "r.b[0].c: empty", "r.b[0].z: unknown", "r.b[1]: not a record", "r.d: not a flag"],
        '{"a": null, "b": {"c": 1}}': ["r.a: null", "r.b: not a list"],
        "[1]": ["r: not a record"], "{": ["r: no JSON"], None: ["r: no JSON"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.f for r in df.select("t", C.faults(F.col("t"), spec, [rule], "r").alias("f")).collect()}
    assert got == cases
    ok = df.select(C.accepted(F.col("t"), "a int", C.faults(F.col("t"), spec, [rule], "r")).alias("s")).filter("s is not null")
    assert [r.s.a for r in ok.collect()] == [1]


def test_a_text_is_parsed_once(spark):
    inner = C.Record({"x": C.Number(0, 9, integer=True), "y": C.Text(nonempty=True)})
    spec = C.Record({"a": C.Record({"b": inner, "c": C.Number(0)}), "d": C.Items(inner, 1, 2, unique="x")})
    rules = [C.Rule("c above x", lambda v: C.number(v, "$.a.c") > C.number(v, "$.a.b.x"))]
    plan = spark.range(1).select(C.faults(F.col("id").cast("string"), spec, rules).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json(") == 1


def test_a_network_as_an_expression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1, 100, 1, 1] + 5
    y = ((x[:, 0] - 5) * (x[:, 2] - 5) > 0).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int")
    net = network.fit(df, "x", "y", [16, 8], 200, 1)
    out = df.select("y", net.scores(F.col("x")).alias("p"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    for r, v in zip(rows, x):
        a = (v - net.centre) / net.spread
        for w, b in net.layers[:-1]:
            a = 1 / (1 + np.exp(-(w @ a + b)))
        z = net.layers[-1][0] @ a + net.layers[-1][1]
        e = np.exp(z - z.max())
        assert r.p == pytest.approx((e / e.sum()).tolist(), abs=1e-9)
    assert np.mean([(r.p[1] > 0.5) == r.y for r in rows]) > 0.9 and net.iterations > 3


def test_a_run_goes_on_and_can_be_cancelled(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(rng.normal(size=3).tolist(), int(i % 2)) for i in range(80)], "x array<double>, y int")
    want, _ = studies.descend(df, "x", "y", 6, 0.5, 0.5)
    seen = []

    def step(k, w):
        seen.append(k)
        if k == 3 and seen.count(3) == 1:
            raise RuntimeError("the driver is lost")
        return studies.descend(df, "x", "y", 1, 0.5, 0.5, start=w)[0].tolist(), False

    with pytest.raises(RuntimeError):
        runs.Run(spark, f"file://{tmp_path}/r").advance([0.0] * 3, step, 6)
    done, w, ended = runs.Run(spark, f"file://{tmp_path}/r").advance([0.0] * 3, step, 6)
    assert (done, ended) == (6, "steps") and w == pytest.approx(want.tolist()) and seen == [0, 1, 2, 3, 3, 4, 5]
    run = runs.Run(spark, f"file://{tmp_path}/c")
    slow = F.udf(lambda i: time.sleep(60) or i, "long")
    threading.Timer(4, run.cancel).start()
    began = time.time()
    assert run.advance(0, lambda k, s: (spark.range(1).select(slow("id")).collect()[0][0], False), 5)[2] == "cancelled" and time.time() - began < 50


def test_eigenvalues_within_their_error(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    k = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = np.linalg.eigvalsh(k)[::-1]
    for tolerance in (0.05, 1e-4):
        r = spectrum.spectrum(df, "id", "x", 0.3, tolerance, 256)
        assert r["trace"] == 300 and r["error"] <= tolerance * 300 and r["pivots"] <= 256
        own = r["eigenvalues"]
        assert (own <= want[: len(own)] + 1e-6).all() and (want[: len(own)] <= own + r["error"] + 1e-6).all()
    assert r["frobenius"] == pytest.approx(np.sqrt((k * k).sum()), rel=1e-3)
    assert spectrum.spectrum(df.filter("false"), "id", "x", 0.3)["pivots"] == 0


def test_norm_of_a_kernel_is_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 6))  # more rows than pivots would be
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    df = spark.createDataFrame([*rows, (-1, None)], "id long, x array<double>").repartition(3)
    for block in (8192, 100):
        n, norm = spectrum.norm(df, "id", "x", 0.5, block)
        assert n == 1500 and norm == pytest.approx(np.sqrt((k * k).sum()), rel=1e-12)
    assert spectrum.norm(df.filter("id = 7"), "id", "x", 0.5) == (1, 1.0) and spectrum.norm(df.filter("false"), "id", "x", 0.5) == (0, 0.0)


def test_lag_of_a_stream(spark, tmp_path):
    folder = f"file://{tmp_path}/lag"
    listener = lag.LagListener(spark, folder)
    spark.streams.addListener(listener)
    try:
        spark.range(30).write.parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        source.writeStream.format("noop").queryName("lagging").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(30):
            if listener.told:
                break
            time.sleep(1)
        rows = lag.lag(spark, folder).collect()
        assert sum(r.rows for r in rows) == 30 and {r.name for r in rows} == {"lagging"} and all(r.age_ms >= 0 for r in rows)
    finally:
        spark.streams.removeListener(listener)
