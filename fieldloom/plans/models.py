"""Queries on `embeddings` and on windows of `events`: kernels, landmarks, encoders, learners, studies, spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import array_digest
from ..operators import harmonic, kernel, metrics, network, selection, statistics, studies
from ..registry import query
from ..shared import quantiles, stored
from ..sources.tables import table
from . import labels, series

GAMMA, WIDTH = 0.5, 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x: all coordinates as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _marks(rows: DataFrame) -> list[tuple[int, list[float]]]:
    """The landmarks: at most 32 rows, balanced by label."""
    chosen = kernel.landmarks(rows.withColumn("lineage", F.col("vec_id")), "vec_id", "lineage", "label")
    return [(r.vec_id, r.x) for r in chosen.select("vec_id", "ordinal").join(rows.select("vec_id", "x"), "vec_id").orderBy("vec_id").collect()]


_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
_LM = f"{_V}, lm AS (SELECT vec_id AS mark, x AS m FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) AS k FROM v) WHERE k <= (SELECT least(32 // count(*), min(n)) FROM (SELECT count(*) AS n FROM v GROUP BY label)))"


@query(f"WITH {_LM} SELECT vec_id, mark, round(list_inner_product(x, m), 5) AS k FROM v, lm")
def cross_kernel_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows against the landmarks, which go along as literals."""
    rows = vectors(spark, sf_dir)
    return kernel.cross_kernel(rows, "vec_id", "x", _marks(rows)).withColumn("k", F.round("k", 5))


@query(f"WITH {_LM} SELECT vec_id, mark, round(exp(-{GAMMA} * pow(list_distance(x, m), 2)), 6) AS k FROM v, lm")
def landmark_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return kernel.cross_kernel(rows, "vec_id", "x", _marks(rows), GAMMA).withColumn("k", F.round("k", 6))


@query(f"WITH {_LM}, k AS (SELECT exp(-{GAMMA} * pow(list_distance(x, m), 2)) AS k FROM v, lm WHERE vec_id NOT IN (SELECT mark FROM lm)) SELECT round(min(k), 6) AS low, round(max(k), 6) AS high, round(avg(k), 6) AS mean, round(stddev_pop(k), 6) AS sd FROM k")
def test_kernel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the kernel between the landmarks and all other rows."""
    rows = vectors(spark, sf_dir)
    marks = _marks(rows)
    rest = rows.filter(~F.col("vec_id").isin([m for m, _ in marks]))
    return kernel.cross_kernel(rest, "vec_id", "x", marks, GAMMA).agg(*[F.round(f("k"), 6).alias(n) for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg), ("sd", F.stddev_pop))])


_GRAM = f"{_V}, g AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.x, b.x) AS k, CASE WHEN a.label < 5 THEN 1.0 ELSE -1.0 END AS la, CASE WHEN b.label < 5 THEN 1.0 ELSE -1.0 END AS lb FROM v a, v b)"


@query(f"WITH {_GRAM}, c AS (SELECT k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS c, (la - avg(la) OVER ()) * (lb - avg(lb) OVER ()) AS t FROM g) SELECT round(1 - sum(c * t) / sqrt(sum(c * c) * sum(t * t)), 6) AS loss FROM c")
def gram_center_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred alignment of the kernel of all rows, from sums of products of coordinates."""
    loss = kernel.alignment_loss(vectors(spark, sf_dir), "x", F.when(F.col("label") < 5, 1.0).otherwise(-1.0))
    return spark.createDataFrame([(round(loss, 6),)], "loss double")


@query(f"WITH {_GRAM} SELECT round(sum(CASE WHEN i = j THEN k END), 4) AS trace, round(avg(CASE WHEN i <> j THEN k END), 6) AS off_mean, round(stddev_pop(CASE WHEN i <> j THEN k END), 6) AS off_sd FROM g")
def kernel_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = kernel.gram_figures(vectors(spark, sf_dir), "x")
    return spark.createDataFrame([(round(r["trace"], 4), round(r["off_mean"], 6), round(r["off_sd"], 6))], "trace double, off_mean double, off_sd double")


@query()
def nystrom_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates among the landmarks, what they leave unexplained, and whether that is beyond the 99th percentile."""
    rows = vectors(spark, sf_dir)
    e = kernel.embed(F.col("x"), np.array([m for _, m in _marks(rows)]), GAMMA)
    out = stored(rows.select("vec_id", e.alias("e")).select("vec_id", "e.z", "e.residual"))
    limit = quantiles(out.select("residual"), [], "residual", 0.99).first()[0]
    return out.withColumn("ood", F.col("residual") > limit)


_X0 = "m AS (SELECT avg(x[1]) AS a, stddev_pop(x[1]) AS s FROM v)"


@query(f"WITH {_V}, {_X0} SELECT vec_id, round(pi() / 2 * tanh((x[1] - a) / CASE WHEN s > 1e-12 THEN s ELSE 1 END / 2), 6) AS angle, round(fmod(fmod(x[2] + pi(), 2 * pi()) + 2 * pi(), 2 * pi()) - pi(), 6) AS phase FROM v, m")
def phase_direct_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = vectors(spark, sf_dir).select("vec_id", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(WIDTH)])
    x = studies.phase_direct(wide, [f"x{i}" for i in range(WIDTH)])
    return x.select("vec_id", F.round(F.get("x", F.lit(0)), 6).alias("angle"), F.round(F.get("x", F.lit(studies.PHASE)), 6).alias("phase"))


_W, _B = studies.frequencies(WIDTH, 4, GAMMA, 3)
_COS = ", ".join(f"cos(list_inner_product(x, {w.tolist()}::DOUBLE[]) + {float(b)!r}) * {float(np.sqrt(2 / len(_B)))!r}" for w, b in zip(_W, _B, strict=True))


@query(f"WITH {_V} SELECT vec_id, unnest([0, 1, 2, 3]) AS j, round(unnest([{_COS}]), 6) AS z FROM v")
def random_fourier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = studies.random_features(F.col("x"), _W, _B)
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(z).alias("j", "z")).withColumn("z", F.round("z", 6))


@query(f"""WITH {_V}, p AS (SELECT x, row_number() OVER (ORDER BY md5('1:' || vec_id), vec_id) AS k FROM v), a AS (SELECT x AS p FROM p WHERE k = 1), b AS (SELECT x AS q FROM p WHERE k = 2),
c AS (SELECT vec_id, exp(-{GAMMA} * pow(list_distance(x, p), 2)) - exp(-{GAMMA} * pow(list_distance(x, q), 2)) AS score FROM v, a, b), d AS (SELECT *, CASE WHEN score >= 0 THEN 1 ELSE -1 END AS label FROM c)
SELECT vec_id, label, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(score) DESC, score, vec_id) AS place FROM d) WHERE place <= 20""")
def positive_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the kernel tells apart best, half of them near each of two prototypes."""
    rows = vectors(spark, sf_dir)
    two = rows.orderBy(selection.lot("vec_id", 1), "vec_id").limit(2).collect()
    return studies.positive_control(rows, "vec_id", "x", [(r.vec_id, r.x) for r in two], GAMMA, 40).withColumn("score", F.round("score", 6))


def _study(told: str) -> str:
    return f"""WITH {_V}, r AS (SELECT vec_id, (label % 2)::VARCHAR AS truth, x, replica FROM v, (SELECT unnest(range(4)) AS replica)),
l AS (SELECT *, ('0x' || substr(md5('17s:' || replica || ':' || vec_id), 1, 8))::BIGINT % 4 < 3 AS train, {told} AS told FROM r),
z AS (SELECT vec_id, truth, told, train, replica, 'raw' AS method, x AS z FROM l UNION ALL SELECT vec_id, truth, told, train, replica, 'sign', list_transform(x, lambda v: sign(v)::DOUBLE) FROM l),
e AS (SELECT vec_id, truth, told, train, replica, method, unnest(range(1, 65)) AS i, unnest(z) AS v FROM z),
c AS (SELECT replica, method, told, i, avg(v) AS c FROM e WHERE train GROUP BY ALL),
d AS (SELECT e.vec_id, e.truth, e.replica, e.method, c.told, round(sum((v - c) * (v - c)), 9) AS d FROM e JOIN c ON c.replica = e.replica AND c.method = e.method AND c.i = e.i WHERE NOT train GROUP BY ALL),
s AS (SELECT vec_id, truth, replica, method, arg_min(told, (d, told)) AS said FROM d GROUP BY ALL),
k AS (SELECT replica, method, cls, sum(a) AS support, sum(h) AS hits, sum(p) AS said FROM (SELECT replica, method, truth AS cls, 1 AS a, 0 AS p, (truth = said)::INT AS h FROM s UNION ALL SELECT replica, method, said, 0, 1, 0 FROM s) GROUP BY ALL)
SELECT replica, method, sum(support)::BIGINT AS n, round(avg(CASE WHEN support > 0 THEN hits / support END), 6) AS balanced_accuracy, round(avg(CASE WHEN support > 0 THEN CASE WHEN hits > 0 THEN 2.0 * hits / (support + said) ELSE 0 END END), 6) AS macro_f1 FROM k GROUP BY ALL"""


def _replicas(spark: SparkSession, sf_dir: str, permute: bool) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("y", F.col("label") % 2)
    methods = {"raw": F.col("x"), "sign": F.transform("x", lambda v: F.signum(v))}
    out = studies.replicated_study(rows, "vec_id", "x", "y", 4, 17, methods, permute)
    return out.select("replica", "method", "n", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(_study("truth"))
def replicated_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replicas(spark, sf_dir, False)


@query(_study("(('0x' || substr(md5('17p:' || replica || ':' || vec_id), 1, 8))::BIGINT % 2)::VARCHAR"))
def permutation_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replicas(spark, sf_dir, True)


@query(f"WITH {_V}, e AS (SELECT unnest(range(64)) AS i, unnest(x) AS v, label % 2 AS y FROM v), g AS (SELECT i, sum((0.5 - y) * v) / count(*) AS g FROM e GROUP BY i), l AS (SELECT 0.5 * sqrt(sum(g * g)) AS l FROM g) SELECT i, round(-0.5 * g * least(1, 0.01 / l), 8) AS w FROM g, l")
def gradient_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capped step of logistic descent over all rows: its weights."""
    w, _ = studies.descend(vectors(spark, sf_dir).withColumn("y", F.col("label") % 2), "x", "y", 1, 0.5, 0.01)
    return spark.createDataFrame([(i, round(float(v), 8)) for i, v in enumerate(w)], "i long, w double")


def _fitted(spark: SparkSession, sf_dir: str, learner, x=None) -> DataFrame:
    """Scores of all rows by a pyspark.ml classifier that is fitted on all rows of the training split."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors(spark, sf_dir).withColumn("y", F.col("label") % 2)
    split = stored(selection.lineage_split(rows, "vec_id", "y", 5))  # read for the fit and for the scores
    ready = split.select("vec_id", "y", "split", array_to_vector(F.col("x") if x is None else x).alias("features"), F.col("y").cast("double").alias("truth"))
    model = learner.setLabelCol("truth").setFeaturesCol("features").fit(ready.filter("split = 'TRAIN'"))
    scored = model.transform(ready)
    raw = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.select("vec_id", "split", F.get(vector_to_array(raw), F.lit(1)).alias("score"), F.col("prediction").cast("int").alias("said"), "y")


@query()
def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 32-16 network on standardised features, applied as one expression; rows of uncertain score abstain."""
    from ..functions import scalar

    rows = vectors(spark, sf_dir).withColumn("y", F.col("label") % 2)
    split = stored(selection.lineage_split(rows, "vec_id", "y", 5))
    net = network.fit(split.filter("split = 'TRAIN'"), "x", "y", [32, 16], 100, 3)
    scored = split.select("vec_id", "split", F.get(net.scores(F.col("x")), F.lit(1)).alias("score"), "y")
    out = scored.select("vec_id", "split", "score", (F.col("score") > 0.5).cast("int").alias("said"), "y", F.lit(net.converged).alias("converged"))
    return out.withColumn("uncertain", scalar.uncertain(F.array("score", 1 - F.col("score"))))


@query()
def kernel_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear machine on 256 random features of the Gaussian kernel."""
    from pyspark.ml.classification import LinearSVC

    w, b = studies.frequencies(WIDTH, 256, GAMMA, 9)
    return _fitted(spark, sf_dir, LinearSVC(maxIter=20, regParam=0.01), studies.random_features(F.col("x"), w, b))


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import GBTClassifier

    return _fitted(spark, sf_dir, GBTClassifier(maxIter=10, maxDepth=3, seed=3))


@query()
def bootstrap_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.predictions(spark, sf_dir).filter("p is not null")
    return metrics.bootstrap_accuracy(rows, "t", "p", 1000, 11)


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the gain of one rule over another on the same resamples."""
    rows = labels.predictions(spark, sf_dir).filter("p is not null").withColumn("q", F.when(F.col("n_chars") > 400, "1").otherwise("0"))
    return metrics.paired_bootstrap(rows, "t", "p", "q", 2000, 12)


@query(f"""WITH {series.FEATURES}, d AS (SELECT round(f0 - f2, 6) AS d FROM f), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS c FROM d),
s AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS minus, count(*) AS n, sum((d = 0)::INT) AS zeros, sum(CASE WHEN d <> 0 THEN c * c - 1.0 ELSE 0 END) AS ties FROM k)
SELECT least(plus, minus) AS statistic, n, zeros::BIGINT AS zeros, round(abs(least(plus, minus) - (n * (n + 1) - zeros * (zeros + 1)) / 4) / sqrt((n * (n + 1.0) * (2 * n + 1) - zeros * (zeros + 1.0) * (2 * zeros + 1)) / 24 - ties / 48), 6) AS z FROM s""")
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.features(spark, sf_dir).select(F.round(F.col("f0") - F.col("f2"), 6).alias("delta"))
    r = statistics.signed_ranks(rows, "delta").first()
    return spark.createDataFrame([(float(min(r.plus, r.minus)), r.n, r.zeros, round(statistics.signed_z(r), 6))], "statistic double, n long, zeros long, z double")


@query()
def array_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each vector's header and bytes."""
    return vectors(spark, sf_dir).select("vec_id", array_digest("x").alias("digest"))


@query()
def harmonic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.anomalies(spark, sf_dir).filter("a is not null")
    rows = w.select("sensor", "s", F.col("a").alias("x"), F.transform("a", lambda _: F.lit(False)).alias("clipped"), F.lit(293.15).alias("temperature"), F.col("s").cast("double").alias("start_s"))
    return harmonic.harmonic_features(rows, 1.0).select("sensor", "s", "h.*")


@query()
def dipole_observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the nations of a region, set on a grid, would see one dipole."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.array((F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double"), (F.col("n_nationkey") % 3) * 0.4).alias("at"))
    nets = n.groupBy(F.col("n_regionkey").alias("network")).agg(F.array_sort(F.collect_list("at")).alias("nodes"))
    source, steps = F.lit([0.5, 0.4, 6.0, 0.3, 0.2, 1.0]), F.lit([1e-3] * 6)
    return nets.select("network", studies.observability("nodes", source, F.transform("nodes", lambda _: F.lit(1e-10)), steps).alias("o")).select("network", "o.*")
