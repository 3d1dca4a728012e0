"""An evaluation from candidates to one scoring of the test split, and the gates on its way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import metrics


def candidates(rows: DataFrame, grid: dict[str, list[tuple[float, Column]]]) -> DataFrame:
    """rows for each candidate, with method, parameter and said: grid has each method's parameters and predictions."""
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(p)).alias("parameter"), c.cast("string").alias("said")) for m, own in grid.items() for p, c in own])
    return rows.select("*", F.inline(each))


def select_best(scored: DataFrame, truth: str = "truth") -> DataFrame:
    """The best candidate of each method on the VALIDATION rows: by balanced accuracy, macro F1, then the least parameter."""
    s = metrics.scores(scored.filter("split = 'VALIDATION'"), truth, "said", ["method", "parameter"])
    return metrics.best(s, ["method"], F.desc(F.round("balanced_accuracy", 12)), F.desc(F.round("macro_f1", 12)), F.col("parameter"))


def score_once(scored: DataFrame, frozen: DataFrame, eligible: Column, truth: str = "truth") -> DataFrame:
    """Each frozen candidate on the TEST rows: rows that are not eligible abstain and are counted, the others are scored."""
    chosen = scored.filter("split = 'TEST'").withColumn("eligible", eligible).join(F.broadcast(frozen.select("method", "parameter")), ["method", "parameter"])
    counts = chosen.groupBy("method", "parameter").agg(F.count("*").alias("n"), F.sum((~F.col("eligible")).cast("long")).alias("abstained"))
    return counts.join(metrics.scores(chosen.filter("eligible"), truth, "said", ["method", "parameter"]).drop("n"), ["method", "parameter"])


def abstains(scores: Column, ood: Column, eligible: Column) -> Column:
    """Uncertain, out of distribution, or not eligible; what is not known counts against the row."""
    return F.coalesce(scalar.uncertain(scores), F.lit(True)) | F.coalesce(ood, F.lit(True)) | ~F.coalesce(eligible, F.lit(False))


def predict(rows: DataFrame, scores: Column, classes: list[str], ood: Column, eligible: Column) -> DataFrame:
    """rows with label, abstained and displayed: the class of the highest score (the first of equals), or ABSTAIN."""
    top = F.array_position(scores, F.array_max(scores))
    label = F.element_at(F.array(*map(F.lit, classes)), top.cast("int"))
    out = rows.withColumn("label", label).withColumn("abstained", abstains(scores, ood, eligible))
    return out.withColumn("displayed", F.when(F.col("abstained"), metrics.ABSTAIN).otherwise(F.col("label")))


def pilot_gate(rows: DataFrame, label: str, episode: str, retained: Column, least: float = 0.8) -> DataFrame:
    """For each class: rows, retained rows, their share, episodes that lost all rows, and whether it passes."""
    per = rows.groupBy(label, episode).agg(F.count("*").alias("n"), F.sum(retained.cast("long")).alias("k"))
    out = per.groupBy(label).agg(F.sum("n").alias("n"), F.sum("k").alias("retained"), F.sum((F.col("k") == 0).cast("long")).alias("lost_episodes"))
    share = F.col("retained") / F.col("n")
    return out.withColumn("share", share).withColumn("passes", (share >= least) & (F.col("lost_episodes") == 0))


def ranges(rows: DataFrame, values: str) -> DataFrame:
    """(i, low, high) of each coordinate of an array column."""
    return rows.select(F.posexplode(values).alias("i", "v")).groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def preview_faults(reference: DataFrame, query: DataFrame, id: str, key: str, start: str, end: str) -> DataFrame:  # noqa: A002
    """For each acquisition (key): repeated ids, ids on both sides, and whether all references end before the first query starts."""
    both = reference.select(id, key, start, end, F.lit(True).alias("ref")).unionAll(query.select(id, key, start, end, F.lit(False).alias("ref")))
    per = both.groupBy(key, id).agg(F.count("*").alias("n"), F.countDistinct("ref").alias("sides"), F.max(F.when(F.col("ref"), F.col(end))).alias("ends"), F.min(F.when(~F.col("ref"), F.col(start))).alias("starts"))
    return per.groupBy(key).agg(F.sum((F.col("n") > F.col("sides")).cast("long")).alias("repeated"), F.sum((F.col("sides") > 1).cast("long")).alias("shared"), F.coalesce(F.max("ends") <= F.min("starts"), F.lit(True)).alias("causal"))


def delays(replayed: DataFrame) -> DataFrame:
    """One row over episodes: false positives, detections, censored ones, and quantiles of the delays."""
    one = lambda c: F.sum(c.cast("long"))
    return replayed.agg(F.count("*").alias("episodes"), F.sum("fp_windows").alias("fp_windows"), one(F.col("fp_episode")).alias("fp_episodes"), F.count("delay_s").alias("detected"), one(F.col("censored")).alias("censored"), F.percentile("delay_s", F.lit(0.5)).alias("p50"), F.percentile("delay_s", F.lit(0.95)).alias("p95"))
