"""Queries on labels against a score: the metrics of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..registry import query
from ..sources.tables import table

BASE = "b AS (SELECT doc_id, CAST(quality AS VARCHAR) AS t, CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars > 1000 THEN '1' ELSE '0' END AS p, quality, toxic, n_chars, lang FROM labels JOIN documents USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as truth, a rule on length as prediction, which abstains on every seventh length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    said = F.when(F.col("n_chars") % 7 == 0, F.lit(None)).when(F.col("n_chars") > 1000, "1").otherwise("0")
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("t", F.col("quality").cast("string")).withColumn("p", said)


@query(f"WITH {BASE} SELECT t, count(CASE WHEN p = '0' THEN 1 END) AS \"0\", count(CASE WHEN p = '1' THEN 1 END) AS \"1\", count(CASE WHEN p IS NULL THEN 1 END) AS \"ABSTAIN\" FROM b GROUP BY t")
def confusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(predictions(spark, sf_dir), "t", "p", ["0", "1"])


_CLASS = f"""WITH {BASE}, c AS (SELECT cls, sum(a) AS support, sum(h) AS hits, sum(s) AS said FROM (SELECT t AS cls, 1 AS a, 0 AS s, CASE WHEN t = p THEN 1 ELSE 0 END AS h FROM b UNION ALL SELECT p, 0, 1, 0 FROM b WHERE p IS NOT NULL) GROUP BY cls),
m AS (SELECT cls, support, hits, said, hits / nullif(support, 0) AS recall, hits / nullif(said, 0) AS prec, CASE WHEN hits > 0 THEN 2.0 * hits / (support + said) ELSE 0 END AS f1 FROM c)"""


@query(_CLASS + " SELECT cls, CAST(support AS BIGINT) AS support, round(recall, 6) AS recall, round(prec, 6) AS precision, round(f1, 6) AS f1 FROM m")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.per_class(predictions(spark, sf_dir), "t", "p").select("cls", "support", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query(_CLASS + " SELECT CAST(sum(support) AS BIGINT) AS n, round(avg(recall), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1 FROM m WHERE support > 0")
def balanced_accuracy_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scores(predictions(spark, sf_dir), "t", "p").select("n", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {BASE} SELECT round((sum(CASE WHEN quality = 1 THEN r END) - sum(CASE WHEN quality = 1 THEN 1 END) * (sum(CASE WHEN quality = 1 THEN 1 END) + 1) / 2.0) / (sum(CASE WHEN quality = 1 THEN 1 END) * sum(CASE WHEN quality = 0 THEN 1 END)), 6) AS auc FROM (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM b)")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auc(predictions(spark, sf_dir), F.col("quality") == 1, "n_chars").select(F.round("auc", 6).alias("auc"))


@query(f"WITH {BASE} SELECT lang, count(*) AS n, CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS abstained, round(1 - sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS coverage, CAST(sum(toxic) AS BIGINT) AS toxic FROM b GROUP BY lang")
def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.coverage(predictions(spark, sf_dir), ["lang"], F.col("p").isNull(), toxic=F.col("toxic") == 1)
    return out.withColumn("coverage", F.round("coverage", 6))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is an episode, most have an onset, and high values are detections."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("end_s"), (F.col("value") > 60).alias("positive"), F.when(F.col("user_id") % 3 > 0, F.lit(1705276800.0)).alias("onset_s"))


@query("""WITH w AS (SELECT user_id AS episode, epoch(ts) AS e, value > 60 AS pos, CASE WHEN user_id % 3 > 0 THEN epoch(TIMESTAMP '2024-01-15') END AS onset FROM events)
SELECT episode, CAST(sum(CASE WHEN pos AND (onset IS NULL OR e <= onset) THEN 1 ELSE 0 END) AS BIGINT) AS fp_windows, round(min(CASE WHEN pos AND e > onset THEN e END) - max(onset), 3) AS delay_s, max(onset) IS NOT NULL AND min(CASE WHEN pos AND e > onset THEN e END) IS NULL AS censored FROM w GROUP BY episode""")
def detection_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.replay(episodes(spark, sf_dir)).select("episode", "fp_windows", F.round("delay_s", 3).alias("delay_s"), "censored")


@query(f"""WITH {BASE}, v AS (SELECT n_chars::DOUBLE AS v, sum(quality) AS p, sum(1 - quality) AS n FROM b GROUP BY 1), c AS (SELECT v, sum(p) OVER q AS pb, sum(n) OVER q AS nb, sum(p) OVER () AS pt, sum(n) OVER () AS nt, lead(v) OVER (ORDER BY v) AS nx FROM v WINDOW q AS (ORDER BY v)),
t AS (SELECT coalesce((v + nx) / 2, v + 1) AS threshold, (pt - pb) / pt / 2 + nb / nt / 2 AS ba FROM c UNION ALL SELECT min(v) - 1, 0.5 FROM c) SELECT threshold, round(ba, 6) AS balanced_accuracy FROM t""")
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.thresholds(predictions(spark, sf_dir), F.col("quality") == 1, "n_chars").select("threshold", F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(f"WITH {BASE} SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(stddev_samp(n_chars), 6) AS sd, min(n_chars) AS low, max(n_chars) AS high FROM b GROUP BY lang")
def replica_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.statistics import replica_summary as summary

    out = summary(predictions(spark, sf_dir), "lang", "n_chars")
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "sd")], "low", "high")


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def lexicographic_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return M.best(d, ["lang"], F.desc("n_chars"), F.col("doc_id"))


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN quality - toxic > 1e-12 THEN 'HELPED' WHEN quality - toxic < -1e-12 THEN 'HURT' ELSE 'TIED' END AS verdict FROM labels) GROUP BY verdict")
def paired_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.paired(table(spark, sf_dir, "labels"), "quality", "toxic").groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT doc_id, s0, s1, greatest(s0, s1) < 0.7 OR abs(s0 - s1) < 0.15 AS uncertain FROM (SELECT doc_id, round(1 / (1 + exp(-(n_chars - 2000) / 1000.0)), 6) AS s0, round(1 - 1 / (1 + exp(-(n_chars - 2000) / 1000.0)), 6) AS s1 FROM documents)")
def uncertainty_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import scalar

    p = scalar.sigmoid((F.col("n_chars") - 2000) / 1000.0)
    d = table(spark, sf_dir, "documents").select("doc_id", F.round(p, 6).alias("s0"), F.round(1 - p, 6).alias("s1"))
    return d.withColumn("uncertain", scalar.uncertain(F.array("s0", "s1")))
