"""Queries on `events` as series: a user is a sensor, its events in time order are samples.

Windows have 20 samples, hop 5 and start behind a reference of 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import statistics as S
from ..operators import windows as W
from ..operators.scans import scan
from ..registry import query
from ..shared import let, stored
from ..sources.tables import table

REF, SIZE, HOP = 20, 20, 5
R = "r AS (SELECT user_id AS sensor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x, ts, event_id, event_type, props FROM events)"
REFS = "ref AS (SELECT sensor, CASE WHEN count(x) = 20 THEN avg(x) END AS ref FROM r WHERE i < 20 GROUP BY sensor)"
WIN = f"""{R}, {REFS}, st AS (SELECT sensor, unnest(range(20, max(i) - 18, 5)) AS s FROM r GROUP BY sensor),
w AS (SELECT st.sensor, s, r.i, r.x - ref.ref AS a FROM st JOIN r ON r.sensor = st.sensor AND r.i >= s AND r.i < s + 20 JOIN ref ON ref.sensor = st.sensor)"""
STEP = ", p AS (SELECT *, lag(a) OVER (PARTITION BY sensor, s ORDER BY i) AS b FROM w)"
FEATURES = f"""{WIN}{STEP}, m AS (SELECT *, median(a) OVER (PARTITION BY sensor, s) AS med FROM p),
c AS (SELECT sensor, s, sum(b*a) - sum(a)*sum(b)/19 AS top, 0 AS z FROM p WHERE b IS NOT NULL GROUP BY sensor, s),
f AS (SELECT sensor, s, avg(a) AS f0, 1.4826 * median(abs(a - med)) AS f1, regr_slope(a, CAST(i AS DOUBLE)) AS f2, sqrt(avg((a - b) * (a - b))) AS f5,
 (sum(CASE WHEN b IS NOT NULL THEN a*b END) - sum(CASE WHEN b IS NOT NULL THEN a END) * sum(b) / 19) / nullif(sqrt((sum(CASE WHEN b IS NOT NULL THEN a*a END) - sum(CASE WHEN b IS NOT NULL THEN a END) * sum(CASE WHEN b IS NOT NULL THEN a END) / 19) * (sum(b*b) - sum(b)*sum(b)/19)), 0) AS f6
 FROM m GROUP BY sensor, s)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("sensor"), "ts", "event_id", "event_type", "props", F.col("value").alias("x"))
    return W.indexed(rows, "sensor", "ts", "event_id")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sensor, s, a): complete windows as arrays of differences from the sensor's reference."""
    rows = series(spark, sf_dir).select("sensor", "i", "x")
    found = W.whole_windows(rows, SIZE, HOP, REF, "sensor")
    ref = W.first_of(rows, "sensor", REF)
    return found.join(ref, "sensor").select("sensor", "s", F.transform("t", lambda t: t["x"] - F.col("ref")).alias("a"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return anomalies(spark, sf_dir).select("sensor", "s", W.mean(a).alias("f0"), W.mad(a).alias("f1"), W.slope(a, 1.0).alias("f2"), W.diff_rms(a).alias("f5"), W.lag1(a).alias("f6"))


def _one(name: str, alias: str):
    sql = f"WITH {FEATURES} SELECT sensor, s, round({name}, 6) AS {alias} FROM f"
    run = lambda spark, sf_dir: features(spark, sf_dir).select("sensor", "s", F.round(name, 6).alias(alias))
    return sql, run


for _name, _column, _alias in (("feat_mean_anomaly", "f0", "mean_anomaly"), ("feat_mad", "f1", "mad"), ("feat_slope", "f2", "slope"), ("feat_diff_rms", "f5", "diff_rms"), ("feat_lag1_corr", "f6", "lag1")):
    _sql, _run = _one(_column, _alias)
    _run.__name__ = _name
    query(_sql)(_run)


@query(f"WITH {R}, {REFS} SELECT sensor, round(ref, 6) AS ref FROM ref")
def ref_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_of(series(spark, sf_dir), "sensor", REF).select("sensor", F.round("ref", 6).alias("ref"))


@query(f"WITH {WIN} SELECT sensor, s, count(*) AS n FROM w GROUP BY sensor, s")
def window_slide_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    slid = W.slide(series(spark, sf_dir), SIZE, HOP, REF)
    return slid.groupBy("sensor", "s").agg(F.count("*").alias("n")).filter(F.col("n") == SIZE)


@query(f"WITH {R} SELECT sensor, CAST(floor(i / 20) AS BIGINT) AS w, count(*) AS n, round(sum(x), 6) AS total FROM r GROUP BY ALL HAVING count(*) = 20")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    slid = W.slide(series(spark, sf_dir), 20, 20)
    return slid.groupBy("sensor", F.expr("s div 20").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total")).filter("n = 20")


@query(f"WITH {FEATURES} SELECT sensor, s, round(f0, 6) AS mean_anomaly FROM f QUALIFY s = max(s) OVER (PARTITION BY sensor)")
def window_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest(features(spark, sf_dir).select("sensor", "s", F.round("f0", 6).alias("mean_anomaly")), "sensor")


_RULE = """, t AS (SELECT quantile_cont(abs(f0), 0.99) AS t0, quantile_cont(f1, 0.99) AS t1, quantile_cont(abs(f2), 0.99) AS t2, quantile_cont(f5, 0.99) AS t5 FROM f WHERE s < 40)"""


def _thresholds(rows: DataFrame) -> DataFrame:
    v = F.array("f0", "f1", "f2", F.lit(0.0), F.lit(0.0), "f5")
    return S.rule_thresholds(rows.filter("s < 40").withColumn("v", v), "v")


@query(f"WITH {FEATURES}{_RULE} SELECT round(t0, 6) AS mean, round(t1, 6) AS spread, round(t2, 6) AS slope, round(t5, 6) AS residual FROM t")
def p99_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thresholds(features(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in S.WATCHED])


@query(f"""WITH {FEATURES}{_RULE}, q AS (SELECT sensor, s, abs(f0) > t0 OR abs(f2) > t2 AS c, f1 > t1 OR f5 > t5 AS d FROM f, t)
SELECT sensor, s, CASE WHEN c AND d THEN 'MIXED' WHEN c THEN 'COMMON' WHEN d THEN 'DISAGREEMENT' ELSE 'NONE' END AS status FROM q""")
def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: reference, sliding windows, robust features, learned thresholds, a status per window."""
    found = stored(features(spark, sf_dir))
    t = _thresholds(found).first()  # one row
    limits = {c: F.lit(t[c]) for c in S.WATCHED}
    return found.select("sensor", "s", S.rule_status(F.abs("f0"), F.col("f1"), F.abs("f2"), F.col("f5"), limits).alias("status"))


_HOURS = "h AS (SELECT event_type AS k, epoch(date_trunc('day', ts)) // 86400 AS d, avg(value) AS v FROM events GROUP BY ALL)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, d, v): a type's mean of the day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("k"), F.unix_date(F.to_date("ts")).cast("long").alias("d")).agg(F.avg("value").alias("v"))


@query(f"WITH {_HOURS}, q AS (SELECT a.k, a.d, a.v - median(b.v) AS r FROM h a JOIN h b ON a.d = b.d AND a.k <> b.k GROUP BY a.k, a.d, a.v HAVING count(*) >= 2) SELECT k, round(sqrt(avg(r * r)), 6) AS residual_rms FROM q GROUP BY k")
def feat_peer_residual_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out: a day's types fit one row, so peers come from one group."""
    day = _daily(spark, sf_dir).groupBy("d").agg(F.collect_list(F.struct("k", "v")).alias("all")).select("all", F.inline("all"))
    peers = F.transform(F.filter("all", lambda p: p["k"] != F.col("k")), lambda p: p["v"])
    rest = day.filter(F.size("all") >= 3).select("k", (F.col("v") - W.median(peers)).alias("r"))
    return rest.groupBy("k").agg(F.round(F.sqrt(F.avg(F.col("r") * F.col("r"))), 6).alias("residual_rms"))


@query(f"WITH {_HOURS} SELECT a.k AS a, b.k AS b, round(corr(a.v, b.v), 6) AS r FROM h a JOIN h b ON a.d = b.d AND a.k < b.k GROUP BY ALL")
def feat_peer_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _daily(spark, sf_dir)
    a, b = h.select(F.col("k").alias("a"), "d", F.col("v").alias("x")), h.select(F.col("k").alias("b"), "d", F.col("v").alias("y"))
    sums = a.join(b, "d").filter("a < b").groupBy("a", "b").agg(*[F.sum(F.expr(e)).alias(n) for n, e in (("n", "1.0"), ("sx", "x"), ("sy", "y"), ("sxx", "x*x"), ("syy", "y*y"), ("sxy", "x*y"))])
    bottom = F.sqrt(F.expr("(sxx - sx*sx/n) * (syy - sy*sy/n)"))
    return sums.select("a", "b", F.round(F.expr("sxy - sx*sy/n") / F.when(bottom > scalar.EPS, bottom), 6).alias("r"))


@query(f"WITH {_HOURS} SELECT a.k AS k, b.k AS peer, a.d, round(a.v - b.v, 6) AS diff FROM h a JOIN h b ON a.d = b.d AND a.k <> b.k")
def peer_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _daily(spark, sf_dir)
    b = h.select(F.col("k").alias("peer"), "d", F.col("v").alias("w"))
    return h.join(b, "d").filter("k <> peer").select("k", "peer", "d", F.round(F.col("v") - F.col("w"), 6).alias("diff"))


@query(f"WITH {_HOURS} SELECT a.k, a.d, round(a.v - b.v, 6) AS diff FROM h a JOIN h b ON a.d = b.d AND b.k = 'view' WHERE a.k <> 'view'")
def reference_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _daily(spark, sf_dir)
    ref = h.filter("k = 'view'").select("d", F.col("v").alias("w"))
    return h.filter("k <> 'view'").join(ref, "d").select("k", "d", F.round(F.col("v") - F.col("w"), 6).alias("diff"))


@query(f"WITH {R}, st AS (SELECT sensor, unnest(range(20, max(i) - 18, 5)) AS s FROM r GROUP BY sensor) SELECT st.sensor, s, round(count(CASE WHEN event_type <> 'error' THEN 1 END) / 20.0, 6) AS received FROM st JOIN r ON r.sensor = st.sensor AND r.i >= s AND r.i < s + 20 GROUP BY ALL")
def feat_received_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each window's samples that are no errors."""
    rows = series(spark, sf_dir).select("sensor", "i", (F.col("event_type") != "error").cast("double").alias("x"))
    found = W.whole_windows(rows, SIZE, HOP, REF, "sensor")
    return found.select("sensor", "s", F.round(W.total(F.transform("t", lambda t: t["x"])) / SIZE, 6).alias("received"))


_BINS = 9
_DFT = f"""WITH {WIN}, d AS (SELECT sensor, s, i - s AS n, a - (avg(a) OVER q + regr_slope(a, CAST(i AS DOUBLE)) OVER q * (i - s - 9.5)) AS v, 0.5 - 0.5 * cos(2 * pi() * (i - s) / 19) AS h FROM w WINDOW q AS (PARTITION BY sensor, s)),
k AS (SELECT sensor, s, b, power(sum(v * h * cos(2 * pi() * b * n / 20)), 2) + power(sum(v * h * sin(2 * pi() * b * n / 20)), 2) AS p FROM d, (SELECT unnest(range(1, 10)) AS b) GROUP BY ALL)
SELECT sensor, s, round(10 * log10(greatest(sum(CASE WHEN b <= 3 THEN p END), 1e-12) / greatest(sum(CASE WHEN b > 3 THEN p END), 1e-12)), 5) AS ratio_db FROM k GROUP BY ALL"""


@query(_DFT)
def band_power_dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low over high band power in dB, by a short transform in array expressions (bins 1-3 over 4-9)."""
    from math import cos, pi, sin

    a, n = F.col("a"), SIZE
    flat = let(F.struct(W.mean(a).alias("m"), W.slope(a, 1.0).alias("k")), lambda line: F.transform(a, lambda x, k: x - line["m"] - line["k"] * (k - (n - 1) / 2)))
    hann = F.array(*[F.lit(0.5 - 0.5 * cos(2 * pi * k / (n - 1))) for k in range(n)])
    rows = anomalies(spark, sf_dir).select("sensor", "s", F.zip_with(flat, hann, lambda x, h: x * h).alias("v"))

    def power(b: int):
        part = lambda f: W.total(F.zip_with("v", F.array(*[F.lit(f(2 * pi * b * k / n)) for k in range(n)]), lambda x, y: x * y))
        return part(cos) * part(cos) + part(sin) * part(sin)

    low, high = (sum((power(b) for b in r[1:]), power(r[0])) for r in (range(1, 4), range(4, _BINS + 1)))
    return rows.select("sensor", "s", F.round(scalar.ratio_db(low, high), 5).alias("ratio_db"))


@query(f"""WITH {R}, b AS (SELECT *, CASE WHEN event_type = 'error' OR coalesce(lag(event_type) OVER (PARTITION BY sensor ORDER BY i) = 'error', true) THEN 1 ELSE 0 END AS brk FROM r),
g AS (SELECT *, sum(brk) OVER (PARTITION BY sensor ORDER BY i) AS run FROM b), u AS (SELECT sensor, run, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM g WHERE event_type <> 'error' GROUP BY ALL)
SELECT sensor, first_i, last_i, n FROM u QUALIFY last_i = max(last_i) OVER (PARTITION BY sensor) AND n >= 4""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.islands(series(spark, sf_dir), "sensor", F.col("event_type") != "error", 4)


@query(f"WITH {R} SELECT sensor, i, round(last_value(CASE WHEN event_type <> 'error' THEN x END IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY i), 6) AS held FROM r")
def stuck_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.held(series(spark, sf_dir), "sensor", F.col("event_type") == "error").select("sensor", "i", F.round("held", 6).alias("held"))


@query(f"WITH {R} SELECT sensor, i, round(sum(x) OVER (PARTITION BY sensor ORDER BY i), 4) AS walk FROM r")
def random_walk_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(series(spark, sf_dir), ["sensor"], ["i"], sums={"walk": F.col("x")}).select("sensor", "i", F.round("walk", 4).alias("walk"))


@query("SELECT event_id, ts, false AS gap FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def cursor_page_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import page

    return page(table(spark, sf_dir, "events"), 100, 50, "event_id").select("event_id", "ts", "gap")


@query("SELECT count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 512)")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latency(table(spark, sf_dir, "events"), "value", "event_id").select("n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT user_id, round(regr_slope(value, epoch(ts) / 3600.0), 8) AS per_hour FROM events GROUP BY user_id")
def trend_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.expr("regr_slope(value, unix_micros(cast(ts as timestamp)) / 1e6 / 3600)"), 8).alias("per_hour"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || ':' || user_id || ':' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS label FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), scalar.window_id(F.col("event_type"), F.col("user_id"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")).alias("label"))


@query("SELECT event_id, sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR))) AS digest FROM events")
def ids_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import by_digest

    return by_digest(table(spark, sf_dir, "events"), "event_id", "event_type", "user_id").select("event_id", "digest")


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def flag_histogram_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))
    return n.groupBy("user_id").agg(pairs.alias("m")).select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("histogram"))


@query("SELECT event_id, round(fmod(fmod(value + pi(), 2 * pi()) + 2 * pi(), 2 * pi()) - pi(), 6) AS phase, round(sin(value), 6) AS sine, round(cos(value), 6) AS cosine FROM events")
def phase_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = table(spark, sf_dir, "events"), scalar.circle(F.col("value"))
    return e.select("event_id", F.round(scalar.wrap_phase(F.col("value")), 6).alias("phase"), F.round(F.get(c, F.lit(0)), 6).alias("sine"), F.round(F.get(c, F.lit(1)), 6).alias("cosine"))


@query("SELECT event_id, round(pi() / 2 * tanh((value - m) / s / 2), 6) AS angle FROM events, (SELECT avg(value) AS m, CASE WHEN stddev_pop(value) > 1e-12 THEN stddev_pop(value) ELSE 1 END AS s FROM events)")
def angle_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    m = S.standardiser(e, ["value"]).first()
    return e.select("event_id", F.round(scalar.angle(F.col("value"), F.lit(m.value_mean), F.lit(m.value_sd)), 6).alias("angle"))


@query("SELECT event_id, round(x, 9) AS x, round(y, 9) AS y FROM (SELECT event_id, greatest(least(value - 50, 25), -25) AS x, value * 1e-9 * 1e9 AS y FROM events)")
def clip_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import geometry as G

    e = table(spark, sf_dir, "events")
    held = G.clip(F.array(F.col("value") - 50, F.lit(0.0), F.lit(0.0)), 25.0)["v"]
    return e.select("event_id", F.round(G.at(held, 0), 9).alias("x"), F.round(F.col("value") * 1e-9 * G.NANO, 9).alias("y"))
