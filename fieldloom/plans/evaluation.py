"""Queries of an evaluation: candidates, freezing, one scoring, gates, predictions, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import evaluation as E
from ..operators import metrics as M
from ..operators import statistics as S
from ..operators.selection import lineage_split
from ..operators.windows import mean
from ..registry import query
from ..shared import quantiles, stored
from ..sources.tables import table
from . import labels, series

CUTS = (200, 400, 700, 1000, 1500, 2500, 4000)
_SPLIT = """b AS (SELECT doc_id, quality::VARCHAR AS truth, n_chars, lang, row_number() OVER (PARTITION BY quality ORDER BY md5('9:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, CASE WHEN k <= round_even(n * 0.6, 0) THEN 'TRAIN' WHEN k <= round_even(n * 0.8, 0) THEN 'VALIDATION' ELSE 'TEST' END AS split FROM b),
c AS (SELECT r.*, method, p::DOUBLE AS parameter, CASE WHEN (method = 'long') = (n_chars >= p) THEN '1' ELSE '0' END AS said FROM r, (SELECT unnest(['long', 'short']) AS method), (SELECT unnest([""" + ", ".join(map(str, CUTS)) + """]) AS p))"""


def _metrics(source: str, by: str) -> str:
    return f"""(SELECT {by}, sum(support)::BIGINT AS n, avg(CASE WHEN support > 0 THEN hits / support END) AS ba, avg(CASE WHEN support > 0 THEN CASE WHEN hits > 0 THEN 2.0 * hits / (support + told) ELSE 0 END END) AS f1
 FROM (SELECT {by}, cls, sum(a) AS support, sum(h) AS hits, sum(p) AS told FROM (SELECT {by}, truth AS cls, 1 AS a, 0 AS p, (truth = said)::INT AS h FROM {source} UNION ALL SELECT {by}, said, 0, 1, 0 FROM {source}) GROUP BY ALL) GROUP BY {by})"""


_BEST = f"best AS (SELECT * FROM {_metrics('(SELECT * FROM c WHERE split = ' + chr(39) + 'VALIDATION' + chr(39) + ')', 'method, parameter')} QUALIFY row_number() OVER (PARTITION BY method ORDER BY round(ba, 12) DESC, round(f1, 12) DESC, parameter) = 1)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a split, and each candidate's prediction: two methods of rules on length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", F.col("quality").cast("string").alias("truth"), "n_chars", "lang")
    long_ = lambda t: (F.col("n_chars") >= t).cast("int")
    return E.candidates(lineage_split(rows, "doc_id", "truth", 9), {"long": [(t, long_(t)) for t in CUTS], "short": [(t, 1 - long_(t)) for t in CUTS]})


@query(f"WITH {_SPLIT}, {_BEST} SELECT method, parameter, n, round(ba, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1 FROM best")
def select_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each method on the validation split."""
    out = E.select_best(scored(spark, sf_dir))
    return out.select("method", "parameter", "n", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""WITH {_SPLIT}, {_BEST}, t AS (SELECT c.*, n_chars % 7 <> 0 AS eligible FROM c JOIN best USING (method, parameter) WHERE split = 'TEST')
SELECT method, parameter, n, abstained, round(ba, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1 FROM (SELECT method, parameter, count(*) AS n, sum((NOT eligible)::INT)::BIGINT AS abstained FROM t GROUP BY ALL) JOIN (SELECT method, parameter, ba, f1 FROM {_metrics('(SELECT * FROM t WHERE eligible)', 'method, parameter')}) USING (method, parameter)""")
def frozen_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen candidates on the test split, once; lengths that seven divides are not eligible."""
    rows = scored(spark, sf_dir)
    frozen = stored(E.select_best(rows))
    out = E.score_once(rows, frozen, F.col("n_chars") % 7 != 0)
    return out.select("method", "parameter", "n", "abstained", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {labels.BASE}, d AS (SELECT lang, t AS truth, p AS said FROM b WHERE p IS NOT NULL) SELECT lang, n, round(ba, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1 FROM {_metrics('d', 'lang')}")
def subgroup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced accuracy and F1 of each language."""
    out = M.scores(labels.predictions(spark, sf_dir).filter("p is not null"), "t", "p", ["lang"])
    return out.select("lang", "n", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("""WITH w AS (SELECT user_id AS episode, epoch(ts) AS e, value > 60 AS pos, CASE WHEN user_id % 3 > 0 THEN epoch(TIMESTAMP '2024-01-15') END AS onset FROM events),
d AS (SELECT episode, sum((pos AND (onset IS NULL OR e <= onset))::INT) AS fp, min(CASE WHEN pos AND e > onset THEN e END) - max(onset) AS delay, max(onset) IS NOT NULL AS has FROM w GROUP BY episode)
SELECT count(*) AS episodes, sum(fp)::BIGINT AS fp_windows, sum((fp > 0)::INT)::BIGINT AS fp_episodes, count(delay) AS detected, sum((has AND delay IS NULL)::INT)::BIGINT AS censored, round(quantile_cont(delay, 0.5), 3) AS p50, round(quantile_cont(delay, 0.95), 3) AS p95 FROM d""")
def delay_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.delays(M.replay(labels.episodes(spark, sf_dir)))
    return out.withColumn("p50", F.round("p50", 3)).withColumn("p95", F.round("p95", 3))


#: Frozen parameters of the scorer: a weight for each encoded feature.
WEIGHTS = {"f0": 0.9, "f1": -0.4, "f2": 0.6, "f5": 0.3}
_ANGLES = " + ".join(f"{w} * (pi() / 2 * tanh(({c} - m{c}) / CASE WHEN s{c} > 1e-12 THEN s{c} ELSE 1 END / 2))" for c, w in WEIGHTS.items())
_SCALE = ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}" for c in WEIGHTS)


@query(f"""WITH {series.FEATURES}{series._RULE}, z AS (SELECT {_SCALE} FROM f WHERE s < 40), sc AS (SELECT sensor, s, f0, f6, 1 / (1 + exp(-({_ANGLES}))) AS p, abs(f0) > t0 OR abs(f2) > t2 AS c, f1 > t1 OR f5 > t5 AS d, t0 FROM f, z, t),
q AS (SELECT *, greatest(p, 1 - p) < 0.7 OR abs(2 * p - 1) < 0.15 AS uncertain, abs(f0) > t0 AS ood, f6 IS NOT NULL AS eligible FROM sc)
SELECT sensor, s, round(p, 6) AS score, CASE WHEN c AND d THEN 'MIXED' WHEN c THEN 'COMMON' WHEN d THEN 'DISAGREEMENT' ELSE 'NONE' END AS status, uncertain, ood, CASE WHEN uncertain OR ood OR NOT eligible THEN 'ABSTAIN' WHEN 1 - p >= p THEN 'background' ELSE 'event' END AS displayed FROM q""")
def bundle_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, score, apply the rule, and abstain where the score is uncertain, the window is unlike training, or a feature lacks."""
    found = stored(series.features(spark, sf_dir))
    train = found.filter("s < 40")
    m, t = S.standardiser(train, list(WEIGHTS)).first(), series._thresholds(found).first()
    z = sum((w * scalar.angle(F.col(c), F.lit(m[f"{c}_mean"]), F.lit(m[f"{c}_sd"])) for c, w in WEIGHTS.items()), F.lit(0.0))
    rows = found.withColumn("p", scalar.sigmoid(z))
    scores, ood = F.array(1 - F.col("p"), F.col("p")), F.abs("f0") > t["mean"]
    out = E.predict(rows, scores, ["background", "event"], ood, F.col("f6").isNotNull())
    status = S.rule_status(F.abs("f0"), F.col("f1"), F.abs("f2"), F.col("f5"), {c: F.lit(t[c]) for c in S.WATCHED})
    return out.select("sensor", "s", F.round("p", 6).alias("score"), status.alias("status"), scalar.uncertain(scores).alias("uncertain"), ood.alias("ood"), "displayed")


@query("""WITH e AS (SELECT event_type, user_id, count(*) AS n, sum((value < 120)::INT) AS k FROM events GROUP BY ALL)
SELECT event_type, sum(n)::BIGINT AS n, sum(k)::BIGINT AS retained, sum((k = 0)::INT)::BIGINT AS lost_episodes, round(sum(k) / sum(n), 6) AS share, sum(k) / sum(n) >= 0.8 AND sum((k = 0)::INT) = 0 AS passes FROM e GROUP BY event_type""")
def pilot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each class keeps enough rows and no episode loses all."""
    out = E.pilot_gate(table(spark, sf_dir, "events"), "event_type", "user_id", F.col("value") < 120)
    return out.withColumn("share", F.round("share", 6))


@query("SELECT i, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (SELECT unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY i")
def pilot_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    return E.ranges(x, "x").select("i", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_PICK = """pk AS (SELECT sensor, s, sensor || ':' || CASE WHEN s % 35 = 0 THEN 0 ELSE s END AS id, s + 20 AS e FROM f)"""


@query(f"""WITH {series.FEATURES}, {_PICK}, u AS (SELECT sensor, id, s, e, true AS ref FROM pk WHERE s < 40 OR (sensor % 4 = 0 AND s = 45) UNION ALL SELECT sensor, id, s, e, false FROM pk WHERE s >= 60 - 20 * (sensor % 2)),
g AS (SELECT sensor, id, count(*) AS n, count(DISTINCT ref) AS sides, max(CASE WHEN ref THEN e END) AS ends, min(CASE WHEN NOT ref THEN s END) AS starts FROM u GROUP BY ALL)
SELECT sensor, sum((n > sides)::INT)::BIGINT AS repeated, sum((sides > 1)::INT)::BIGINT AS shared, coalesce(max(ends) <= min(starts), true) AS causal FROM g GROUP BY sensor""")
def preview_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a choice of reference and query windows of each sensor; some are wrong on purpose."""
    s = F.col("s")
    w = series.features(spark, sf_dir).select("sensor", "s", F.concat_ws(":", F.col("sensor").cast("string"), F.when(s % 35 == 0, F.lit(0)).otherwise(s).cast("string")).alias("id"), (s + 20).alias("e"))
    ref = w.filter((s < 40) | ((F.col("sensor") % 4 == 0) & (s == 45)))
    return E.preview_faults(ref, w.filter(s >= 60 - 20 * (F.col("sensor") % 2)), "id", "sensor", "s", "e")


@query(f"""WITH {series.FEATURES}, ms AS (SELECT sensor, avg(f0) AS a0, stddev_pop(f0) AS s0, avg(f1) AS a1, stddev_pop(f1) AS s1 FROM f WHERE s < 40 GROUP BY sensor),
z AS (SELECT f.sensor, s, (f0 - a0) / CASE WHEN s0 > 1e-12 THEN s0 ELSE 1 END AS x, (f1 - a1) / CASE WHEN s1 > 1e-12 THEN s1 ELSE 1 END AS y FROM f JOIN ms ON ms.sensor = f.sensor),
k AS (SELECT q.sensor, q.s, exp(-0.5 * (pow(q.x - r.x, 2) + pow(q.y - r.y, 2))) AS k FROM z q JOIN z r ON r.sensor = q.sensor AND r.s < 40 WHERE q.s >= 60)
SELECT sensor, count(*) AS n, round(min(k), 6) AS low, round(max(k), 6) AS high, round(avg(k), 6) AS mean FROM k GROUP BY sensor""")
def preview_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sensor's later windows against its few reference windows, scaled by those: the kernel's spread."""
    f = stored(series.features(spark, sf_dir).select("sensor", "s", "f0", "f1"))
    ref = f.filter("s < 40")
    m = ref.groupBy("sensor").agg(*[x for c in ("f0", "f1") for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
    scaled = f.join(m, "sensor").select("sensor", "s", *[((F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") > 1e-12, F.col(f"{c}_s")).otherwise(1.0)).alias(n) for c, n in (("f0", "x"), ("f1", "y"))])
    r = scaled.filter("s < 40").select("sensor", F.col("x").alias("a"), F.col("y").alias("b"))
    k = scaled.filter("s >= 60").join(r, "sensor").select("sensor", F.exp(-0.5 * (F.pow(F.col("x") - F.col("a"), F.lit(2)) + F.pow(F.col("y") - F.col("b"), F.lit(2)))).alias("k"))
    return k.groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.min("k"), 6).alias("low"), F.round(F.max("k"), 6).alias("high"), F.round(F.avg("k"), 6).alias("mean"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars // 2000 DESC, source = 'src1' DESC, doc_id) AS k FROM documents) WHERE k = 1")
def tie_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest document of each language, in steps of 2000; of equals one of the preferred source."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "source", F.expr("n_chars div 2000").alias("k"))
    return M.best(d, ["lang"], F.desc("k"), F.desc(F.col("source") == "src1"), F.col("doc_id")).select("lang", "doc_id")
