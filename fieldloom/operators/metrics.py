"""Evaluation of predictions: confusion, balanced accuracy, macro F1, AUC, coverage, replay, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import sums_before

ABSTAIN = "ABSTAIN"


def confusion(rows: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """A row per true class, a column per prediction and one for abstentions, zeros filled in."""
    said = F.when(F.col(predicted).isin(labels), F.col(predicted)).otherwise(ABSTAIN)
    order = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{truth} string")
    counted = rows.withColumn("_said", said).groupBy(truth).pivot("_said", [*labels, ABSTAIN]).count()
    return order.join(counted, truth, "left").na.fill(0)


def per_class(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """support, hits, said, recall, precision, f1 per class (and group): two sides of one pass."""
    by = by or []
    sides = F.array(F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("h")), F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))
    s = rows.select(*by, F.inline(sides)).groupBy(*by, "cls").agg(F.sum("t").alias("support"), F.sum(F.coalesce("h", F.lit(0))).alias("hits"), F.sum("p").alias("said")).filter("cls is not null")
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    s = s.withColumn("recall", div("hits", "support")).withColumn("precision", div("hits", "said"))
    return s.withColumn("f1", F.when(F.col("hits") > 0, 2.0 * F.col("hits") / (F.col("support") + F.col("said"))).otherwise(0.0))


def scores(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None, zero_support: str = "skip", labels: int = 2) -> DataFrame:
    """balanced_accuracy and macro_f1.  Classes without support: skip them, keep them as zeros, or null the row."""
    c = per_class(rows, truth, predicted, by)
    mine = F.col("support") > 0
    ba, f1 = F.avg(F.when(mine, F.col("recall"))), F.avg(F.when(mine, F.col("f1")))
    if zero_support == "keep":
        f1 = F.sum("f1") / labels
    if zero_support == "null":
        whole = F.sum(mine.cast("int")) == labels
        ba, f1 = F.when(whole, ba), F.when(whole, f1)
    return c.groupBy(*(by or [])).agg(F.sum("support").alias("n"), ba.alias("balanced_accuracy"), f1.alias("macro_f1"))


def auc(rows: DataFrame, positive: Column, score: str) -> DataFrame:
    """Area under the ROC curve from counts per distinct score: ties count half."""
    counts = rows.filter(F.col(score).isNotNull()).groupBy(score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    below = sums_before(counts, [], [score], ["n"])
    return below.agg((F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2.0)) / F.when(F.sum("p") * F.sum("n") > 0, F.sum("p") * F.sum("n"))).alias("auc"))


def coverage(rows: DataFrame, by: list[str], abstained: Column, **reasons: Column) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), n(abstained).alias("abstained"), (1 - n(abstained) / F.count("*")).alias("coverage"), *[n(v).alias(k) for k, v in reasons.items()])


def replay(windows: DataFrame, onset: str = "onset_s", end: str = "end_s", positive: str = "positive") -> DataFrame:
    """Per episode: false positives before the onset, delay of the first detection after it, censored if none.

    Episodes without onset are all before.
    """
    p = F.col(positive)
    before = F.col(onset).isNull() | (F.col(end) <= F.col(onset))
    false = F.sum((p & before).cast("long"))
    first = F.min(F.when(p & ~before, F.col(end)))
    out = windows.groupBy("episode").agg(F.max(onset).alias("onset_s"), false.alias("fp_windows"), (false > 0).alias("fp_episode"), first.alias("first_s"))
    return out.withColumn("delay_s", F.col("first_s") - F.col("onset_s")).withColumn("censored", F.col("onset_s").isNotNull() & F.col("first_s").isNull())


def thresholds(rows: DataFrame, positive: Column, score: str) -> DataFrame:
    """(threshold, balanced_accuracy) of calling score >= threshold positive, for every midpoint of distinct scores and both ends.

    Counts per distinct score and running sums over ranges of scores: no cross join of thresholds and rows.
    """
    counts = rows.groupBy(F.col(score).cast("double").alias("v")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    c = sums_before(counts, [], ["v"], ["p", "n"], "v").select("v", (F.col("p_before") + F.col("p")).alias("pb"), (F.col("n_before") + F.col("n")).alias("nb"), F.col("p_all").alias("pt"), F.col("n_all").alias("nt"), "next")
    above = c.select(F.when(F.col("next").isNull(), F.col("v") + 1.0).otherwise((F.col("v") + F.col("next")) / 2).alias("threshold"), ((F.col("pt") - F.col("pb")) / F.col("pt") / 2 + F.col("nb") / F.col("nt") / 2).alias("balanced_accuracy"))
    lowest = c.agg((F.min("v") - 1.0).alias("threshold"), F.lit(0.5).alias("balanced_accuracy"))
    return above.unionAll(lowest)


def best(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in an order: lexicographic selection."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def paired(rows: DataFrame, a: str, b: str, tie: float = 1e-12) -> DataFrame:
    d = F.col(a) - F.col(b)
    return rows.withColumn("delta", d).withColumn("verdict", F.when(d > tie, "HELPED").when(d < -tie, "HURT").otherwise("TIED"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _draws(seeds: pd.Series, n: pd.Series, shares: pd.Series) -> pd.Series:
    """Seeded multinomial counts."""
    return pd.Series([np.random.default_rng(int(s)).multinomial(int(k), np.asarray(p, float) / np.sum(p)).tolist() for s, k, p in zip(seeds, n, shares, strict=True)])


def bootstrap(cells: DataFrame, stratum: str, cell: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, stratum, cell, n): how often seeded resamples of the size of each stratum draw rows of each cell.

    cells: counts (stratum, cell, n) of equal rows, so a resample is a multinomial draw of counts and no rows are
    drawn; stratum null for a plain bootstrap.  The seed is the stratum's and the replicate's.
    """
    listed = cells.groupBy(stratum).agg(F.array_sort(F.collect_list(F.struct(F.col(cell).alias("cell"), F.col("n")))).alias("c"))
    each = listed.select(stratum, "c", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    drawn = each.withColumn("d", _draws(F.abs(F.xxhash64(stratum, "replicate", F.lit(seed)) % (1 << 62)), total, F.transform("c", lambda x: x["n"].cast("double"))))
    return drawn.select("replicate", stratum, F.inline(F.zip_with("c", "d", lambda x, k: F.struct(x["cell"].alias(cell), k.alias("n")))))


def interval(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """replicates, low, high: the percentile interval of a value over replicates (as many rows as replicates)."""
    return values.groupBy(*(by or [])).agg(F.count("*").alias("replicates"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def bootstrap_accuracy(rows: DataFrame, truth: str, predicted: str, replicates: int, seed: int) -> DataFrame:
    """replicates, low, high: interval of balanced accuracy over stratified resamples."""
    cells = rows.groupBy(F.col(truth).alias("stratum"), F.coalesce((F.col(truth) == F.col(predicted)).cast("int"), F.lit(0)).alias("hit")).agg(F.count("*").alias("n"))
    recall = bootstrap(cells, "stratum", "hit", replicates, seed).groupBy("replicate", "stratum").agg((F.sum(F.col("hit") * F.col("n")) / F.sum("n")).alias("recall"))
    return interval(recall.groupBy("replicate").agg(F.avg("recall").alias("ba")), "ba")


def paired_bootstrap(rows: DataFrame, truth: str, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """replicates, low, high of the difference of two predictions' balanced accuracies on the same resamples."""
    hit = lambda c: F.coalesce((F.col(truth) == F.col(c)).cast("int"), F.lit(0))
    cells = rows.groupBy(F.col(truth).alias("stratum"), (2 * hit(a) + hit(b)).alias("both")).agg(F.count("*").alias("n"))
    gain = F.when(F.col("both") == 2, 1).when(F.col("both") == 1, -1).otherwise(0)
    delta = bootstrap(cells, "stratum", "both", replicates, seed).groupBy("replicate", "stratum").agg((F.sum(gain * F.col("n")) / F.sum("n")).alias("delta"))
    return interval(delta.groupBy("replicate").agg(F.avg("delta").alias("delta")), "delta")
