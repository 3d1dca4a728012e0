"""Queries on `events` as five long series, one for each type: recursions, latches, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, scans
from ..registry import query
from ..sources.tables import table

SHARE, THERMAL_S, BANDWIDTH, OU_S, SIGMA = 0.2, 3600.0, 1e-4, 1800.0, 2.0
LEVEL, HOLD = 100.0, 21_600.0
#: Kept apart so that both sides begin with the same doubles.
_ROWS = "e AS (SELECT event_type AS sensor, event_id, value AS x, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("sensor"), "event_id", F.col("value").alias("x"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


ORDER = ["t", "event_id"]


@query(f"""WITH RECURSIVE {_ROWS}, y AS (SELECT sensor, event_id, i, x AS m FROM e WHERE i = 1 UNION ALL SELECT e.sensor, e.event_id, e.i, m + {SHARE} * (x - m) FROM y JOIN e ON e.sensor = y.sensor AND e.i = y.i + 1)
SELECT sensor, event_id, round(m, 6) AS mean FROM y""")
def exponential_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponentially weighted mean along each series."""
    return scans.exponential_mean(_long(spark, sf_dir), ["sensor"], ORDER, "x", SHARE).select("sensor", "event_id", F.round("mean", 6).alias("mean"))


@query(f"""WITH RECURSIVE {_ROWS}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY sensor ORDER BY i) AS dt FROM e),
y AS (SELECT sensor, event_id, i, 290.0::DOUBLE AS k, x AS f FROM d WHERE i = 1 UNION ALL SELECT d.sensor, d.event_id, d.i, k + (1 - exp(-dt / {THERMAL_S})) * (290 + x / 10 - k), f + (1 - exp(-2 * pi() * {BANDWIDTH} * dt)) * (x - f) FROM y JOIN d ON d.sensor = y.sensor AND d.i = y.i + 1)
SELECT sensor, event_id, round(k, 6) AS kelvin, round(f, 6) AS filtered FROM y""")
def thermal_low_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body that follows 290 K and a tenth of the value with a lag, from 290 K on, and the low-passed value."""
    rows = _long(spark, sf_dir).withColumn("ambient", 290 + F.col("x") / 10)
    warm = scans.relaxed(rows, ["sensor"], ORDER, "ambient", "t", 1 / THERMAL_S, start=290.0, column="kelvin")
    both = scans.relaxed(warm, ["sensor"], ORDER, "x", "t", 2 * 3.141592653589793 * BANDWIDTH, column="filtered")
    return both.select("sensor", "event_id", F.round("kelvin", 6).alias("kelvin"), F.round("filtered", 6).alias("filtered"))


@query(f"""WITH RECURSIVE {_ROWS}, d AS (SELECT *, exp(-coalesce(t - lag(t) OVER (PARTITION BY sensor ORDER BY i), 0) / {OU_S}) AS k FROM e),
y AS (SELECT sensor, event_id, i, {SIGMA} * sqrt(1 - k * k) * (x - 50) / 30 AS s FROM d WHERE i = 1 UNION ALL SELECT d.sensor, d.event_id, d.i, k * s + {SIGMA} * sqrt(1 - k * k) * (x - 50) / 30 FROM y JOIN d ON d.sensor = y.sensor AND d.i = y.i + 1)
SELECT sensor, event_id, round(s, 6) AS noise FROM y""")
def correlated_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Ornstein-Uhlenbeck state driven by the values, standardised by fixed numbers."""
    rows = _long(spark, sf_dir).withColumn("unit", (F.col("x") - 50) / 30)
    return scans.correlated(rows, ["sensor"], ORDER, "unit", "t", SIGMA, OU_S).select("sensor", "event_id", F.round("noise", 6).alias("noise"))


_LATCH = f"""{_ROWS}, c AS (SELECT sensor, event_id, t, row_number() OVER (PARTITION BY sensor ORDER BY i) AS n FROM e WHERE x > {LEVEL}),
y AS (SELECT sensor, n, t + {HOLD} AS until, true AS latches FROM c WHERE n = 1 UNION ALL SELECT c.sensor, c.n, CASE WHEN c.t >= until THEN c.t + {HOLD} ELSE until END, c.t >= until FROM y JOIN c ON c.sensor = y.sensor AND c.n = y.n + 1),
l AS (SELECT c.sensor, c.event_id, c.t, y.until FROM y JOIN c ON c.sensor = y.sensor AND c.n = y.n WHERE latches)"""


def _latched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.latches(_long(spark, sf_dir).filter(F.col("x") > LEVEL), ["sensor"], "t", "event_id", HOLD)


@query(f"WITH RECURSIVE {_LATCH} SELECT sensor, event_id, t, until FROM l")
def latch_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings above a level that start a dropout of six hours; while one lasts no other starts."""
    return _latched(spark, sf_dir).select("sensor", "event_id", "t", "until")


@query(f"""WITH RECURSIVE {_LATCH}, h AS (SELECT e.sensor, e.event_id, e.i, e.x, coalesce(e.t < l.until, false) AS dropped FROM e ASOF LEFT JOIN l ON e.sensor = l.sensor AND e.t >= l.t)
SELECT sensor, event_id, dropped, round(last_value(CASE WHEN event_id % 7 <> 0 THEN x END IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY i), 6) AS held FROM h""")
def latch_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading: whether a dropout covers it, and what a sensor stuck at each seventh event would repeat."""
    rows = _long(spark, sf_dir)
    until = _latched(spark, sf_dir).select("sensor", F.col("t").alias("since"), "until")
    covered = joins.as_of(rows, until, "sensor", "t", "since", "until")
    told = scans.scan(covered, ["sensor"], ORDER, carry={"held": F.when(F.col("event_id") % 7 != 0, F.col("x"))})
    return told.select("sensor", "event_id", F.coalesce(F.col("t") < F.col("until"), F.lit(False)).alias("dropped"), F.round("held", 6).alias("held"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS k, epoch(o_orderdate) AS a, epoch(o_orderdate) + 864000 AS b, o_orderpriority AS g FROM orders)
SELECT x.k, x.id AS first, y.id AS second FROM s x JOIN s y ON x.k = y.k AND x.g <> y.g AND (x.a, x.id) < (y.a, y.id) AND x.b > y.a""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders of different priority that are open at the same time."""
    day = 86_400.0
    a = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), a.alias("a"), (a + 10 * day).alias("b"), F.col("o_orderpriority").alias("g"))
    return joins.overlap_pairs(s, "k", "id", "a", "b", "g", 10 * day)
