"""Queries on observation frames made of `events`.

Fifteen users are a session, an event type is a sensor, and the i-th event of each
sensor is its reading in frame i.  A value below 0.1 has no vector, one above 300
is clipped, every 997th event is marked stuck.  Clock: 10 Hz; windows of 40 frames
each 20, behind a reference of 80.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, state8
from ..operators.windows import latest
from ..registry import query
from ..shared import ranked
from ..sources.tables import READING, table

HZ, REF, SIZE, HOP = 10.0, 80, 40, 20
SHAPE = {"first": REF, "size": SIZE, "hop": HOP, "hz": HZ}
EPOCH = 1_704_067_200_000_000  # 2024-01-01 in microseconds


def reading(sensor: Column, sequence: Column, value: Column, event: Column) -> Column:
    clock = F.timestamp_micros(F.lit(EPOCH) + sequence * int(1e6 / HZ))
    null = F.lit(None)
    fields = {
        "sensor_id": sensor,
        "sequence_id": sequence,
        "acquisition_time": clock,
        "arrival_time": clock,
        "measurement_mode": F.lit("vector"),
        "value_T": null,
        "components_T": F.when(value >= 0.1, F.array(value * 1e-9, F.lit(0.0), F.lit(4e-5))),
        "saturation_mask": F.array(value > 300, F.lit(False), F.lit(False)),
        "quality_flags": F.when(event % 997 == 0, F.array(F.lit("stuck"))).otherwise(F.array().cast("array<string>")),
        "valid": F.lit(True),
        "observed_temperature_K": 290 + value / 100,
        "position_m": F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        "orientation_world_to_sensor_wxyz": F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        "calibration_version": F.lit("v1"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(READING)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("session_id", F.expr("user_id div 15").cast("string"))
    placed = ranked(e.withColumn("series", F.concat_ws(":", "session_id", "event_type")), ["series"], [F.col("ts"), F.col("event_id")], "i")
    read = placed.select("session_id", "i", reading(F.col("event_type"), F.col("i") + 1, F.col("value"), F.col("event_id")).alias("r"))
    framed = read.groupBy("session_id", "i").agg(F.array_sort(F.collect_list("r")).alias("readings"))
    return framed.select("session_id", F.lit(1).alias("configuration_version"), (F.col("i") + 1).alias("frame_id"), (F.col("i") / HZ).alias("sim_time_s"), "readings")


_E = """e AS (SELECT CAST(user_id // 15 AS VARCHAR) AS session, event_type AS sensor, row_number() OVER (PARTITION BY user_id // 15, event_type ORDER BY ts, event_id) - 1 AS i,
 CASE WHEN value >= 0.1 THEN value END AS x, 290 + value / 100 AS k, list_filter([CASE WHEN value < 0.1 THEN 'missing_vector_components' END, CASE WHEN value > 300 THEN 'clipped' END, CASE WHEN event_id % 997 = 0 THEN 'stuck' END], lambda f: f IS NOT NULL) AS flags FROM events),
n AS (SELECT session, max(i) + 1 AS n FROM e GROUP BY session),
ref AS (SELECT e.session, sensor, count(*) AS n, max(n.n) AS n_frames, (count(CASE WHEN len(flags) = 0 THEN 1 END) = 80) AS valid, avg(CASE WHEN len(flags) = 0 THEN x END) AS x0, avg(CASE WHEN len(flags) = 0 THEN k END) AS k0 FROM e JOIN n USING (session) WHERE i < 80 GROUP BY ALL)"""
_WIN = _E + """, g AS (SELECT session, sensor, valid, x0, k0, unnest(range(80, n_frames - 39, 20)) AS s FROM ref),
c AS (SELECT g.session, g.sensor, s, valid, x0, k0, count(e.i) AS n, count(x) AS received, count(CASE WHEN len(flags) = 0 THEN 1 END) AS usable, flatten(list(coalesce(flags, []))) AS own, avg(k) AS k FROM g LEFT JOIN e ON e.session = g.session AND e.sensor = g.sensor AND i >= s AND i < s + 40 GROUP BY ALL),
j AS (SELECT *, valid AND usable = 40 AS whole, list_distinct(list_concat(own, list_filter([CASE WHEN NOT valid THEN 'reference_invalid' END, CASE WHEN n < 40 THEN 'missing_reading' END, CASE WHEN n < 40 THEN 'nonuniform_sequence' END, CASE WHEN n < 40 THEN 'nonuniform_clock' END], lambda f: f IS NOT NULL))) AS flags FROM c),
w AS (SELECT j.session, j.sensor, s, e.i - s AS m, e.x - x0 AS a, lag(e.x - x0) OVER (PARTITION BY j.session, j.sensor, s ORDER BY e.i) AS b FROM j JOIN e ON e.session = j.session AND e.sensor = j.sensor AND e.i >= s AND e.i < s + 40 WHERE whole),
h AS (SELECT *, median(a) OVER q AS med, a - avg(a) OVER q - regr_slope(a, m::DOUBLE) OVER q * (m - 19.5) AS flat FROM w WINDOW q AS (PARTITION BY session, sensor, s)),
p AS (SELECT session, sensor, s, bin, any_value(CASE WHEN bin = 20 THEN 1 ELSE 2 END) * (pow(sum(flat * (0.5 - 0.5 * cos(2 * pi() * m / 39)) * cos(2 * pi() * bin * m / 40)), 2) + pow(sum(flat * (0.5 - 0.5 * cos(2 * pi() * m / 39)) * sin(2 * pi() * bin * m / 40)), 2)) AS power FROM h, (SELECT unnest(range(1, 21)) AS bin) GROUP BY session, sensor, s, bin),
band AS (SELECT session, sensor, s, 10 * log10(sum(CASE WHEN bin < 8 THEN power END) / sum(CASE WHEN bin >= 8 THEN power END)) AS f3 FROM p GROUP BY ALL),
f AS (SELECT session, sensor, s, avg(a) AS f0, 1.4826 * median(abs(a - med)) AS f1, regr_slope(a, m / 10.0) AS f2, sqrt(avg((a - b) * (a - b))) AS f5, corr(a, b) AS f6 FROM h GROUP BY session, sensor, s)"""
_ALL = "round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, round(CASE WHEN whole THEN k - k0 END, 6) AS f4, round({0}f5, 6) AS f5, round({0}f6, 6) AS f6, received / 40.0 AS f7"
_LOCAL = f"WITH {_WIN} SELECT j.session, j.sensor, j.s, {_ALL.format('f.')}, whole AS valid, array_to_string(CASE WHEN whole THEN [] ELSE list_sort(flags) END, ',') AS flags FROM j LEFT JOIN f USING (session, sensor, s) LEFT JOIN band USING (session, sensor, s)"
_NETWORK = f"""WITH {_WIN}, size AS (SELECT session, s, count(*) AS nodes, count(CASE WHEN whole THEN 1 END) AS good FROM j GROUP BY ALL),
d AS (SELECT a.session, a.sensor, a.s, a.m, a.a - median(b.a) AS d FROM w a JOIN w b ON a.session = b.session AND a.s = b.s AND a.m = b.m AND a.sensor <> b.sensor GROUP BY a.session, a.sensor, a.s, a.m, a.a),
r AS (SELECT a.session, a.sensor, a.s, b.sensor AS peer, corr(a.a, b.a) AS r FROM w a JOIN w b ON a.session = b.session AND a.s = b.s AND a.m = b.m AND a.sensor <> b.sensor GROUP BY ALL),
net AS (SELECT session, sensor, s, f5, f6, peers FROM (SELECT session, sensor, s, sqrt(avg(d * d)) AS f5 FROM d GROUP BY ALL) JOIN (SELECT session, sensor, s, CASE WHEN count(r) = count(*) THEN avg(r) END AS f6, string_agg(peer, ',' ORDER BY peer) AS peers FROM r GROUP BY ALL) USING (session, sensor, s) JOIN size USING (session, s) WHERE good >= 3)
SELECT j.session, j.sensor, j.s, {_ALL.format('net.')}, whole AND net.f6 IS NOT NULL AS valid, coalesce(net.peers, '') AS peers FROM j LEFT JOIN f USING (session, sensor, s) LEFT JOIN band USING (session, sensor, s) LEFT JOIN net USING (session, sensor, s) JOIN size USING (session, s)"""


def _flat(features: DataFrame) -> list[Column]:
    each = [F.round(F.get("values", F.lit(k)), 6).alias(f"f{k}") for k in range(7)]
    return [F.col("session_id").alias("session"), F.col("sensor_id").alias("sensor"), "s", *each, F.get("values", F.lit(7)).alias("f7"), "valid"]


@query(_LOCAL)
def state8_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight features of every window, its flags, and whether it abstains."""
    out = state8.features(frames(spark, sf_dir), **SHAPE)
    return out.select(*_flat(out), F.array_join("flags", ",").alias("flags"))


@query(_NETWORK)
def state8_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As state8_local, with the residual from and the correlation with valid peers."""
    out = state8.features(frames(spark, sf_dir), profile="network", **SHAPE)
    return out.select(*_flat(out), F.when(F.col("values")[5].isNotNull(), F.array_join("peers", ",")).otherwise("").alias("peers"))


@query(f"WITH {_WIN} SELECT session, sensor, max(s) AS s, arg_max(whole, s) AS valid FROM j GROUP BY session, sensor")
def state8_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest window of each session alone."""
    out = state8.features(frames(spark, sf_dir), latest=True, **SHAPE)
    return latest(out, "session_id").select(F.col("session_id").alias("session"), F.col("sensor_id").alias("sensor"), "s", "valid")


@query(f"WITH {_E} SELECT session, sensor, CASE WHEN valid THEN round(x0, 6) END AS north, CASE WHEN valid THEN round(k0, 6) END AS temperature, valid FROM ref")
def state8_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sensor's means over the reference, null unless all of it is usable."""
    r = state8.reference(frames(spark, sf_dir), REF, HZ)
    return r.select(F.col("session_id").alias("session"), F.col("sensor_id").alias("sensor"), F.round("north_ref", 6).alias("north"), F.round("temperature_ref", 6).alias("temperature"), "valid")


@query(f"WITH {_E} SELECT session, sensor, i, array_to_string(list_sort(flags), ',') AS flags, len(flags) = 0 AS usable, x IS NOT NULL AS received, round(x, 6) AS north FROM e")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading: what makes it unusable."""
    s = quality.samples(quality.readings(quality.index_frames(frames(spark, sf_dir), HZ)))
    return s.select(F.col("session_id").alias("session"), F.col("sensor_id").alias("sensor"), "i", F.array_join("flags", ",").alias("flags"), "usable", "received", F.round("x", 6).alias("north"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames on a clock of hours: a user is a session; every seventh event is off the grid, and hours repeat."""
    e = table(spark, sf_dir, "events")
    hour = F.expr("unix_seconds(cast(ts as timestamp)) div 3600") - EPOCH // 3_600_000_000
    at = hour + F.when(F.col("event_id") % 7 == 0, 0.25).otherwise(0.0)
    r = reading(F.col("event_type"), F.col("event_id"), F.col("value"), F.col("event_id"))
    again = F.when(F.col("event_id") % 5 == 0, F.array(r, r)).otherwise(F.array(r))
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.lit(1).alias("configuration_version"), F.col("event_id").alias("frame_id"), at.cast("double").alias("sim_time_s"), again.alias("readings"))


_HOUR = "h AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id, event_type AS sensor, epoch(ts)::BIGINT // 3600 - 473352 + CASE WHEN event_id % 7 = 0 THEN 0.25 ELSE 0 END AS t FROM (SELECT user_id, event_id, event_type, date_trunc('hour', ts) AS ts FROM events)), o AS (SELECT *, t - min(t) OVER (PARTITION BY session) AS d, min(t) OVER (PARTITION BY session) AS t0 FROM h), ix AS (SELECT *, round_even(d, 0)::BIGINT AS i FROM o)"


@query(f"WITH {_HOUR} SELECT session, i, arg_min(event_id, (t, event_id)) AS frame_id, count(*) > 1 OR max(abs(t - t0 - i)) > 1e-8 AS odd FROM ix GROUP BY session, i")
def frame_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame for each index, the first; whether the index has more or one off the grid."""
    return quality.index_frames(hourly(spark, sf_dir), 1.0).select(F.col("session_id").alias("session"), "i", "frame_id", "odd")


@query(f"WITH {_HOUR}, k AS (SELECT session, i, arg_min(event_id, (t, event_id)) AS frame_id FROM ix GROUP BY session, i) SELECT k.session, k.i, sensor, event_id % 5 = 0 AS twice FROM k JOIN ix ON event_id = frame_id")
def sensor_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading for each sensor of a frame, the first; whether it came twice."""
    r = quality.readings(quality.index_frames(hourly(spark, sf_dir), 1.0))
    return r.select(F.col("session_id").alias("session"), "i", F.col("sensor_id").alias("sensor"), "twice")


@query(f"WITH {_HOUR} SELECT session, event_id AS frame_id, t AS sim_time_s, p AS before_s FROM (SELECT *, lag(t) OVER (PARTITION BY session ORDER BY event_id) AS p FROM h) WHERE t <= p")
def stream_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose time does not come after the one before: none is sorted into place."""
    return quality.order_faults(hourly(spark, sf_dir)).select(F.col("session_id").alias("session"), "frame_id", "sim_time_s", "before_s")


@query(f"WITH {_E} SELECT session, sensor, count(*) = 80 AS sequence, count(*) = 80 AS clock FROM e WHERE i < 80 GROUP BY ALL")
def uniform_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the reference has all its sequence numbers and clock steps."""
    s = quality.samples(quality.readings(quality.index_frames(frames(spark, sf_dir), HZ))).filter(F.col("i") < REF)
    t = s.groupBy("session_id", "sensor_id").agg(F.array_sort(F.collect_list(F.struct("i", "sequence", "micros"))).alias("t"))
    return t.select(F.col("session_id").alias("session"), F.col("sensor_id").alias("sensor"), quality.even(F.col("t"), REF, HZ).alias("e")).select("session", "sensor", "e.sequence", "e.clock")


@query(f"WITH {_WIN}, a AS (SELECT session, max(i) / 10.0 AS t FROM e GROUP BY session) SELECT session, sensor, max(s) AS s, round(max(t) - (max(s) + 40) / 10.0, 6) AS data_age_s, max(t) * 10 + 1 - (max(s) + 40) AS lag_frames FROM j JOIN a USING (session) GROUP BY session, sensor")
def data_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How old each sensor's newest window is, and how many frames it lags behind."""
    f = frames(spark, sf_dir)
    newest = f.groupBy("session_id").agg(F.max("sim_time_s").alias("t"), F.max("frame_id").alias("n"))
    w = state8.windows(f, state8.reference(f, REF, HZ), **SHAPE).groupBy("session_id", "sensor_id").agg(F.max("s").alias("s"))
    age = F.col("t") - (F.col("s") + SIZE) / HZ
    return w.join(newest, "session_id").select(F.col("session_id").alias("session"), F.col("sensor_id").alias("sensor"), "s", F.round(age, 6).alias("data_age_s"), (F.col("n") - F.col("s") - SIZE).cast("double").alias("lag_frames"))
