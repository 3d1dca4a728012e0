"""Geometry, kernels, networks, spectra, statistics, joins, sources and sinks."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from fieldloom.functions import geometry as G
from fieldloom.functions import scalar
from fieldloom.functions.arrays import array_digest
from fieldloom import shared
from fieldloom.operators import harmonic, joins, kernel, metrics, selection, statistics, windows
from fieldloom.sinks import datasets
from fieldloom.sources import tables
from pyspark.sql import functions as F


def lit(v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_geometry(spark):
    row = spark.range(1).select(
        G.canonical(lit((-2, 0, 0, 0))).alias("q"),
        G.to_sensor(lit((math.cos(math.pi / 4), 0, 0, math.sin(math.pi / 4))), lit((1, 0, 0))).alias("turned"),
        G.dipole(lit((0, 0, 0)), lit((0, 0, 1)), lit((0, 0, 2)), F.lit(0.5)).alias("far"),
        G.dipole(lit((0, 0, 0)), lit((0, 0, 1)), lit((0, 0, 1)), F.lit(0.5)).alias("near"),
        G.dipole(lit((0, 0, 0)), lit((0, 0, 1)), lit((0, 0, 0.5)), F.lit(0.5)).alias("inside"),
        G.total(lit((1, 2, 3)), F.lit(None).cast("array<double>")).alias("none"),
        G.clip(lit((5, -5, 1)), 2.0).alias("clip"),
        G.norm(G.spread_pose(F.lit(7))).alias("n"),
        G.radical_inverse(F.lit(6), 2).alias("r"),
        scalar.wrap_phase(F.lit(math.pi)).alias("phase"),
        scalar.softmax(lit((1000, 1000))).alias("soft"),
        scalar.snr_db(F.lit(0.0), F.lit(0.0)).alias("snr"),
        scalar.sigmoid(F.lit(None).cast("double")).alias("null1"),
        scalar.ratio_db(F.lit(1.0), F.lit(None).cast("double")).alias("null2"),
        scalar.sample_index(F.lit(0.025), F.lit(0.0), 100.0).alias("i"),
    ).first()
    assert row.q == [1, 0, 0, 0] and row.turned == pytest.approx([0, 1, 0]) and row.near[2] == pytest.approx(8 * row.far[2])
    assert row.inside is None and row.none is None and row.clip.v == [2, -2, 1] and row.clip.mask == [True, True, False]
    assert row.r == 0.375 and row.phase == -math.pi and row.soft == [0.5, 0.5] and row.snr == 0 and row.i == 2 and row.null1 is None and row.null2 is None


def test_landmark_embedding(spark):
    rng = np.random.default_rng(1)
    marks = rng.normal(size=(6, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in m]) for i, m in enumerate(np.concatenate([marks, rng.normal(size=(9, 8))]))], "id long, x array<double>")
    gram = lambda a, b: np.exp(-0.3 * ((a[:, None] - b[None]) ** 2).sum(axis=2))
    out = sorted((r.id, r.e.z, r.e.residual) for r in rows.select("id", kernel.embed(F.col("x"), marks, 0.3).alias("e")).collect())
    x = np.array([r.x for r in sorted(rows.collect())])
    z = gram(x, marks) @ np.linalg.cholesky(np.linalg.inv(gram(marks, marks) + 1e-6 * np.eye(6)))  # another root, the same products
    mine = np.array([v for _, v, _ in out])
    assert np.allclose(mine @ mine.T, z @ z.T, atol=1e-6) and np.allclose([r for *_, r in out], np.maximum(0, 1 - (z * z).sum(axis=1)), atol=1e-6)
    assert all(r < 1e-4 for *_, r in out[:6])
    with pytest.raises(ValueError, match="negative eigenvalue"):
        kernel.basis(np.array([[1.0, 2.0], [2.0, 1.0]]))
    pool = spark.createDataFrame([(f"e{i:02d}", f"l{i // 2}", "ab"[i % 4 // 2]) for i in range(24)], "id string, lineage string, label string")
    chosen = kernel.landmarks(pool, "id", "lineage", "label", 3, 8).collect()
    assert [r.label for r in chosen] == ["a", "b"] * 4 and len({r.id for r in chosen}) == 8
    assert sorted(map(tuple, kernel.landmarks(pool.orderBy(F.rand(1)), "id", "lineage", "label", 3, 8).collect())) == sorted(map(tuple, chosen))


def test_kernel_figures_equal_the_whole_kernel(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 5)), rng.choice([-1.0, 1.0], 40)
    rows = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(3)
    k = x @ x.T
    off, w = k[~np.eye(40, dtype=bool)], np.clip(np.linalg.eigvalsh(k), 0, None)
    p = w[w > 1e-9] / w.sum()
    got = kernel.gram_figures(rows, "x")
    assert got["trace"] == pytest.approx(np.trace(k)) and got["off_mean"] == pytest.approx(off.mean()) and got["off_sd"] == pytest.approx(off.std())
    assert got["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    h = np.eye(40) - 1 / 40
    c, t = h @ k @ h, h @ np.outer(y, y) @ h
    assert kernel.alignment_loss(rows, "x", F.col("y")) == pytest.approx(1 - (c * t).sum() / np.sqrt((c * c).sum() * (t * t).sum()))


def test_harmonics():
    t = np.arange(400) / 100
    x = np.stack([3 * np.sin(2 * np.pi * 5.1 * t + 0.4) + 0.5 * t, np.ones(400), 3 * np.sin(2 * np.pi * 5.1 * t + 0.4) + 0.5 * t])
    r = harmonic.describe(x, np.array([False, False, True]), np.full(3, 293.0), 100.0, np.zeros(3))
    one, flat, clipped = (r.loc[i] for i in range(3))
    assert (one.amplitude, one.frequency, one.drift) == pytest.approx((3, 5.1, 0.5), rel=0.05) and abs(one.phase - 0.4) < 0.5
    assert one.status == "valid" and one["flags"] == [] and one.snr_db > 10
    assert flat["flags"][:2] == ["almost_constant", "insufficient_cycles"] and flat.frequency == 0
    assert clipped["flags"] == ["clipped"] and clipped.feature_valid == [False] * 7 + [True] and clipped.status == "invalid"
    # A transform term by term, for an even and an odd length.
    for n in (20, 21):
        v, hz = np.random.default_rng(n).normal(size=n), 10.0
        k = np.arange(n)
        flat = v - np.polyval(np.polyfit(k, v, 1), k)
        taper = np.hanning(n)
        f, p = harmonic.spectra(v[None, :], hz)
        for b in range(n // 2 + 1):
            term = abs((flat * taper * np.exp(-2j * np.pi * b * k / n)).sum()) ** 2 / (hz * (taper**2).sum())
            assert p[0, b] == pytest.approx(term * (1 if b == 0 or 2 * b == n else 2)) and f[b] == pytest.approx(b * hz / n)
    assert harmonic.window_shape(0.25, 100, 0.5) == (25, 12)
    with pytest.raises(ValueError, match="16 samples"):
        harmonic.window_shape(0.1, 100, 0)


def test_places_and_quantiles_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([("ab"[i % 2], float(v)) for i, v in enumerate(rng.integers(0, 50, 999))] + [("a", None)], "k string, v double")
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.k: r.v for r in shared.quantiles(rows.repartition(n), ["k"], "v", 0.93).collect()}
        assert got == {k: pytest.approx(np.quantile([r.v for r in rows.collect() if r.k == k and r.v is not None], 0.93)) for k in "ab"}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    long = spark.createDataFrame([(list(range(1000)),)], "a array<bigint>").select(shared.running(F.col("a")).alias("s"), shared.running(F.expr("cast(array() as array<bigint>)")).alias("none")).first()
    assert long.s == [i * (i - 1) // 2 for i in range(1000)] and long.none == []


def test_signed_ranks_equal_brute_force(spark):
    d = [0.0, 0.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0, 5.5, 0.5]
    order = sorted(abs(x) for x in d)
    rank = lambda v: sum(k + 1 for k, o in enumerate(order) if o == v) / order.count(v)
    rows = spark.createDataFrame([(x,) for x in d], "delta double")
    r = statistics.signed_ranks(rows, "delta").first()
    assert (r.plus, r.minus, r.zeros) == (sum(rank(abs(x)) for x in d if x > 0), sum(rank(abs(x)) for x in d if x < 0), 2)
    low, p = statistics.wilcoxon(rows, "delta")
    assert low == r.minus and 0 < p < 1 and statistics.wilcoxon(rows.filter("delta = 0"), "delta") == (0.0, 1.0)


def test_window_functions(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i, float(i * i % 7)) for i in range(50)] + [(2, i, 3.0) for i in range(20)], "k long, i long, x double")
    for size, hop, first in ((10, 5, 0), (10, 3, 4), (7, 7, 0), (5, 9, 2)):
        got = {(r.k, r.s): [t.i for t in r.t] for r in windows.whole(windows.slide(rows, size, hop, first), size, "k", "s").collect()}
        assert got == {(k, s): list(range(s, s + size)) for k, n in ((1, 50), (2, 20)) for s in range(first, n - size + 1, hop)}
        monkeypatch.setattr(windows, "RUN", 3)
        lacking = rows.filter("i <> 23")
        for some in (rows, lacking):
            want = {(r.k, r.s): r.t for r in windows.whole(windows.slide(some, size, hop, first), size, "k", "s").collect()}
            assert {(r.k, r.s): r.t for r in windows.whole_windows(some, size, hop, first, "k").collect()} == want
    flat = windows.whole(windows.slide(rows.filter("k = 2"), 10, 5), 10, "k", "s").select(windows.lag1(F.transform("t", lambda t: t["x"])).alias("r"))
    assert all(r.r is None for r in flat.collect())
    assert statistics.diverse(rows.withColumn("y", F.col("x") * 2), ["x", "y"]) and not statistics.diverse(rows.filter("k = 2"), ["x"])


def test_joins_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [(int(k), float(rng.random() * 20)) for k in range(200)]
    spans = [(f"e{k}", float(a), float(a + d)) for k, (a, d) in enumerate(zip(rng.random(30) * 20, rng.choice([0.0, 0.5, 1.0, 7.0], 30)))]
    got = joins.interval_join(spark.createDataFrame(points, "p long, t double"), spark.createDataFrame(spans, "e string, a double, b double"), "t", "a", "b", 1.0)
    assert sorted((r.p, r.e) for r in got.collect()) == sorted((p, e) for p, t in points for e, a, b in spans if a <= t < b)
    owned = [(f"i{k}", int(rng.integers(3)), float(a), float(a + 1), "xyz"[rng.integers(3)]) for k, a in enumerate(rng.random(60) * 20)]
    hit = {r.id for r in joins.overlaps(spark.createDataFrame(owned, "id string, k long, a double, b double, g string"), "k", "id", "a", "b", "g").collect()}
    assert hit == {y[0] for x, y in itertools.permutations(owned, 2) if x[1] == y[1] and x[4] != y[4] and (x[2], x[0]) < (y[2], y[0]) and x[3] > y[2]}
    own = spark.createDataFrame([("l1", "TRAIN")], "lineage_id string, split string")
    with pytest.raises(Exception, match="no split for lineage"):
        joins.inherit_split(spark.createDataFrame([("l2", "e")], "lineage_id string, episode string"), own).collect()


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), ("b", "b")], "t string, p string")
    c = {r.t: (r.a, r.b, r.ABSTAIN) for r in metrics.confusion(rows, "t", "p", ["a", "b", "c"]).collect()}
    assert c == {"a": (1, 1, 0), "b": (0, 1, 1), "c": (0, 0, 0)}
    only = rows.filter("t = 'a'")
    assert metrics.scores(only, "t", "p").first().macro_f1 == pytest.approx(2 / 3)
    assert metrics.scores(only, "t", "p", zero_support="keep").first().macro_f1 == pytest.approx(1 / 3)
    assert metrics.scores(only, "t", "p", zero_support="null").first().balanced_accuracy is None
    r = metrics.bootstrap_accuracy(rows, "t", "p", 100, 1).first()
    assert 0 <= r.low <= 0.5 <= r.high <= 1 and r.replicates == 100
    many = spark.range(4000).selectExpr("string(id % 2) as t", "if(id % 10 < 7, string(id % 2), 'x') as p", "if(id % 10 < 6, string(id % 2), 'x') as q")
    r, again = (metrics.bootstrap_accuracy(x, "t", "p", 400, 1).first() for x in (many, many.repartition(5)))
    hit = many.groupBy("t").agg(F.avg((F.col("t") == F.col("p")).cast("int")).alias("h")).collect()
    sd = math.sqrt(sum(x.h * (1 - x.h) / 2000 for x in hit)) / 2
    assert r == again and r.low < 0.7 < r.high and (r.high - r.low) == pytest.approx(3.92 * sd, rel=0.2)
    d = metrics.paired_bootstrap(many, "t", "p", "q", 400, 1).first()
    assert d.low < 0.1 < d.high < 0.125 and d.low > 0.075  # paired: far narrower than two intervals


def test_selection_is_independent_of_order(spark):
    rows = spark.createDataFrame([(f"l{i // 3}", f"e{i}", "ab"[i // 3 % 2]) for i in range(60)], "lineage string, e string, label string")
    one, two = (sorted(map(tuple, selection.lineage_split(x, "lineage", "label", 5).collect())) for x in (rows, rows.orderBy(F.desc("e"))))
    assert one == two and joins.split_leaks(selection.lineage_split(rows, "lineage", "label", 5), "lineage").isEmpty()
    assert {s: sum(r[3] == s for r in one) for s in ("TRAIN", "VALIDATION", "TEST")} == {"TRAIN": 36, "VALIDATION": 12, "TEST": 12}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("f0,f1,f2,f3,f4,f5,f6,f7,label\n1,2,3,4,5,6,7,8,1\n1,2,3,4,5,6,7,8,0\n")
    with pytest.raises(Exception, match="not -1 or 1"):
        tables.matrix(spark, str(tmp_path / "m.csv")).collect()
    j = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "b": 2}',)], "t string")
    read = lambda d: d.select(tables.strict_json(F.col("t"), "a int", ["a"]).alias("s")).collect()
    assert read(j.filter("t not like '%b%'"))[0].s.a == 1
    with pytest.raises(Exception, match="unknown fields"):
        read(j)
    data = spark.createDataFrame([(1, "TRAIN", 1.0), (2, "TEST", 2.0)], "id long, split string, x double")
    top = str(tmp_path / "d")
    with pytest.raises(Exception, match="Unable to infer|no such column|cannot|split"):  # the second channel fails, so nothing is published
        datasets.write_dataset({"observations": data, "labels": data.withColumn("x", F.raise_error(F.lit("split it")).cast("double"))}, top)
    with pytest.raises(KeyError, match="lists no"):
        datasets.read_dataset(spark, top, "observations")
    datasets.write_dataset({"observations": data, "labels": data.drop("split")}, top)
    assert datasets.read_dataset(spark, top, "observations", "TRAIN").count() == 1 and datasets.read_dataset(spark, top, "labels").columns == ["id", "x"]
    with pytest.raises(FileExistsError, match="never overwritten"):
        datasets.write_dataset({"observations": data}, top)
    with pytest.raises(KeyError, match="lists no"):
        datasets.read_dataset(spark, top, "generation")
    for f in (tmp_path / "d").glob("data-*/labels/*.parquet"):
        f.unlink()
    with pytest.raises(ValueError, match="not what was published"):
        datasets.read_dataset(spark, top, "labels")
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert datasets.file_digests(spark, str(tmp_path / "f.bin")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert datasets.content_digest(data) == datasets.content_digest(data.orderBy(F.desc("id"))) != datasets.content_digest(data.limit(1))
    ledger = datasets.Ledger(spark, str(tmp_path / "ledger"))
    ledger.append("sealed", by="x")
    with pytest.raises(ValueError, match="can't follow"):
        ledger.append("labels_opened")
    ledger.append("observations_opened")
    assert ledger.rows().count() == 2 and ledger.broken().isEmpty()
    for _ in range(2):
        datasets.append_new(spark, data, str(tmp_path / "review"), "id")
    assert spark.read.parquet(str(tmp_path / "review")).count() == 2
    with pytest.raises(ValueError, match="other content"):
        datasets.append_new(spark, data.withColumn("x", F.lit(9.0)), str(tmp_path / "review"), "id")
    v = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<double>")
    head = b'{"dtype": "<f8", "shape": [2]}\n' + np.array([1.0, -2.5], "<f8").tobytes()
    assert [r[0] for r in v.select(array_digest("v")).collect()] == [hashlib.sha256(head).hexdigest(), None]
    datasets.write_report(data, str(tmp_path / "report"))
    a = spark.createDataFrame([("x", 1, "h")], "path string, bytes long, sha256 string")
    assert datasets.inventory_changes(a, a).isEmpty() and datasets.inventory_changes(a, a.withColumn("sha256", F.lit("g"))).count() == 1
