"""Interval, effective-dating and overlap joins, on time buckets where a range would be scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import scan


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, on: list[str] | None = None) -> DataFrame:
    """points with the spans [start, end) that hold `at`: an equi-join on buckets of `width`, then the exact test.

    A span goes to each bucket it touches; width near the usual length keeps that to two or three.
    """
    a = points.withColumn("_bucket", F.floor(F.col(at) / width))
    ends = F.greatest(F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1)
    b = spans.filter(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), ends)))
    return a.join(b, [*(on or []), "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, take: str) -> DataFrame:
    """left with `take` of the latest right row whose `since` is not after `at`, by key.

    One sort of both sides over ranges and a scan, so a key may fill many partitions; no range join.
    """
    rows = left.withColumn("_take", F.lit(None).cast(right.schema[take].dataType)).withColumn("_at", F.col(at)).withColumn("_left", F.lit(1))
    versions = right.select(F.col(key), F.col(since).alias("_at"), F.col(take).alias("_take")).withColumn("_left", F.lit(0))
    both = rows.unionByName(versions, allowMissingColumns=True)
    return scan(both, [key], ["_at", "_left"], carry={take: F.col("_take")}).filter("_left = 1").select(*left.columns, take)


def overlaps(spans: DataFrame, key: str, id: str, start: str, end: str, group: str) -> DataFrame:  # noqa: A002
    """Spans of one key that start before an earlier span of another group has ended, with how far that one reaches.

    A scan whose state is the two furthest ends of different groups: no pairs, any number of groups, keys of any length.
    """
    return scan(spans, [key], [start, id], rival={"reach": (F.col(end), F.col(group))}).filter(F.col("reach") > F.col(start))


def overlap_pairs(spans: DataFrame, key: str, id: str, start: str, end: str, group: str, width: float) -> DataFrame:  # noqa: A002
    """(key, first, second): ids of two spans of one key and different groups that overlap, by start and then id.

    Only spans that overlaps() names can be second; they meet the spans that hold their start by buckets of `width`.
    """
    late = overlaps(spans, key, id, start, end, group).select(key, F.col(id).alias("second"), F.col(start).alias("_at"), F.col(group).alias("_of"))
    early = spans.select(key, F.col(id).alias("first"), F.col(start).alias("_a"), F.col(end).alias("_b"), F.col(group).alias("_g"))
    before = (F.col("_a") < F.col("_at")) | ((F.col("_a") == F.col("_at")) & (F.col("first") < F.col("second")))
    return interval_join(late, early, "_at", "_a", "_b", width, [key]).filter(before & ~F.col("_g").eqNullSafe(F.col("_of"))).select(key, "first", "second")


def bank(rows: DataFrame, chosen: DataFrame, key: str, ok: Column) -> DataFrame:
    """chosen's rows, in its order, that exist and are valid."""
    return chosen.join(rows.filter(ok).select(key), key, "left_semi")


def unknown(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.join(known, key, "left_anti")


def route(rows: DataFrame, network: DataFrame, local: DataFrame, key: str, column: str) -> DataFrame:
    """The network's result where there is one, else the local one, else an abstention."""
    a = network.select(key, F.col(column).alias("_n"))
    b = local.select(key, F.col(column).alias("_l"))
    source = F.when(F.col("_n").isNotNull(), "network").when(F.col("_l").isNotNull(), "local").otherwise("abstain")
    return rows.join(a, key, "left").join(b, key, "left").withColumn(column, F.coalesce("_n", "_l")).withColumn("route", source).drop("_n", "_l")


def inherit_split(derived: DataFrame, assigned: DataFrame) -> DataFrame:
    """Derived episodes in the split of their lineage; a lineage without one raises an error."""
    own = assigned.select("lineage_id", "split").distinct()
    joined = derived.join(own, "lineage_id", "left")
    return joined.withColumn("split", F.when(F.col("split").isNull(), F.raise_error(F.concat(F.lit("no split for lineage "), "lineage_id"))).otherwise(F.col("split")))


def split_leaks(assigned: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one split."""
    return assigned.groupBy(key).agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; empty when the two are aligned exactly."""
    return a.select(key).exceptAll(b.select(key)).withColumn("side", F.lit("left")).unionAll(b.select(key).exceptAll(a.select(key)).withColumn("side", F.lit("right")))


def scheduled(events: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """events with accepted (strictly later than the key's event before, which the clock has reached) and the version it makes."""
    told = scan(events, [key], [order], lag={"_now": F.col(at)})
    placed = told.withColumn("accepted", F.col("_now").isNull() | (F.col(at) > F.col("_now"))).drop("_now")
    return scan(placed, [key], [order], sums={"version": F.col("accepted").cast("long")}).withColumn("version", F.col("version") + 1)
