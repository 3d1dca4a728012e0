"""Thresholds, rules, signed ranks, kernel diagnostics and trends."""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import quantiles, sums_before

#: What the rule watches, by place in the eight features: absolute mean, spread, absolute slope, peer residual.
WATCHED = {"mean": (0, True), "spread": (1, False), "slope": (2, True), "residual": (5, False)}


def rule_thresholds(rows: DataFrame, values: str, q: float = 0.99) -> DataFrame:
    """One row: the q quantile (linear) of each watched feature over normal training rows."""
    pick = lambda i, size: F.abs(F.get(values, F.lit(i))) if size else F.get(values, F.lit(i))
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), pick(i, size).alias("v")) for n, (i, size) in WATCHED.items()])))
    found = quantiles(long, ["name"], "v", q)
    return found.agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in WATCHED])


def rule_status(mean: Column, spread: Column, slope: Column, residual: Column, t: dict[str, Column]) -> Column:
    """Which of four statuses the exceeded thresholds (strictly) add up to."""
    common = (mean > t["mean"]) | (slope > t["slope"])
    apart = (spread > t["spread"]) | (residual > t["residual"])
    return F.when(common & apart, "MIXED").when(common, "COMMON").when(apart, "DISAGREEMENT").otherwise("NONE")


def standardiser(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population spread of each column."""
    return rows.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_sd") for c in columns])


def signed_ranks(rows: DataFrame, delta: str) -> DataFrame:
    """One row: sums of positive and negative ranks of |delta| with zeros kept (Pratt) and ties averaged.

    Counts per distinct |delta|, summed over ranges of it, carry it.
    """
    c = rows.groupBy(F.abs(delta).alias("a")).agg(F.sum((F.col(delta) > 0).cast("long")).alias("up"), F.sum((F.col(delta) < 0).cast("long")).alias("down"), F.count("*").alias("n"))
    r = sums_before(c, [], ["a"], ["n"]).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2.0)
    zero = F.col("a") == 0
    return r.agg(
        F.sum(F.col("rank") * F.col("up")).alias("plus"),
        F.sum(F.col("rank") * F.col("down")).alias("minus"),
        F.sum("n").alias("n"),
        F.sum(F.when(zero, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(~zero, F.col("n") * F.col("n") * F.col("n") - F.col("n")).otherwise(0)).alias("ties"),
    )


def wilcoxon(rows: DataFrame, delta: str) -> tuple[float, float]:
    """Statistic and two-sided p (normal tail, tie- and zero-corrected); p is 1 if all deltas are 0."""
    r = signed_ranks(rows, delta).first()
    if not r.n or r.n == r.zeros:
        return 0.0, 1.0
    return float(min(r.plus, r.minus)), float(min(1.0, erfc(signed_z(r) / sqrt(2))))


def signed_z(r) -> float:
    """Distance of the lesser rank sum from its mean, in deviations; 0 if all deltas are 0."""
    n, z = r.n or 0, r.zeros or 0
    if n == z:
        return 0.0
    mean = (n * (n + 1) - z * (z + 1)) / 4
    variance = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1)) / 24 - r.ties / 48
    return abs(min(r.plus, r.minus) - mean) / sqrt(variance)


def replica_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def latency(rows: DataFrame, ms: str, order: str, last: int = 512) -> DataFrame:
    """p50 and p95 of the last so many rows (a top-k, so no sort of all)."""
    return rows.orderBy(F.desc(order)).limit(last).agg(F.count("*").alias("n"), F.expr(f"percentile({ms}, 0.5)").alias("p50"), F.expr(f"percentile({ms}, 0.95)").alias("p95"))


def diverse(rows: DataFrame, columns: list[str], least: float = 1e-9) -> bool:
    """Whether centred, scaled rows span more than a point: from sums of products, whatever the number of rows."""
    a = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns], *[F.sum(F.col(c) * F.col(d)).alias(f"p_{c}_{d}") for c in columns for d in columns]).first()
    if not a.n:
        return False
    s = np.array([a[f"s_{c}"] for c in columns])
    p = np.array([[a[f"p_{c}_{d}"] for d in columns] for c in columns])
    cov = p - np.outer(s, s) / a.n
    sd = np.sqrt(np.clip(np.diag(cov) / a.n, 0, None))
    sd = np.where(sd > 1e-12, sd, 1)
    return bool(np.sqrt(max(0.0, np.linalg.eigvalsh(cov / np.outer(sd, sd)).max())) > least)
