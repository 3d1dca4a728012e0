"""Queries on fields of sources, node clocks, buffers, reviews and unions."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar
from ..operators import joins as J
from ..operators import selection as K
from ..operators import statistics as S
from ..registry import query
from ..sinks import datasets
from ..sources.tables import strict_json, table
from ..streaming.state8 import recent


def _vector(*parts: float) -> F.Column:
    return F.array(*[F.lit(float(p)) for p in parts])


_AT = "SELECT event_id, value / 100 - 1 AS x, (user_id % 7) / 7.0 AS y, 0.5::DOUBLE AS z FROM events"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, at): a place for each event."""
    return table(spark, sf_dir, "events").select("event_id", F.array(F.col("value") / 100 - 1, (F.col("user_id") % 7) / 7.0, F.lit(0.5)).alias("at"))


@query(f"""WITH p AS ({_AT}), d AS (SELECT event_id, x, y - 0.2 AS y, z - 0.1 AS z FROM p), r AS (SELECT *, sqrt(x * x + y * y + z * z) AS r, 0.3 * x + 0.2 * y + z AS m FROM d)
SELECT event_id, CASE WHEN r > 0.6 THEN round(100 * (3 * m * x / pow(r, 5) - 0.3 / pow(r, 3)), 6) END AS bx, CASE WHEN r > 0.6 THEN round(100 * (3 * m * z / pow(r, 5) - 1 / pow(r, 3)), 6) END AS bz FROM r""")
def dipole_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field in nT of a dipole at (0, 0.2, 0.1); null where a place is too near."""
    b = G.dipole(_vector(0, 0.2, 0.1), _vector(0.3, 0.2, 1), F.col("at"), 0.6)
    return places(spark, sf_dir).select("event_id", F.round(G.at(b, 0) * G.NANO, 6).alias("bx"), F.round(G.at(b, 2) * G.NANO, 6).alias("bz"))


@query(f"""WITH p AS ({_AT}) SELECT event_id, CASE WHEN x > -0.999 THEN round(5 * exp(-(x * x + y * y + 0.25) / 8) + 3 * sin(2 * pi() * 0.5 * event_id / 10 + 0.4) + 0.1 * x + 0.2 * y, 6) END AS bx FROM p""")
def field_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of an anomaly, a wave and a gradient; null if any of them is."""
    at, t = F.col("at"), F.col("event_id") / 10
    wave = F.when(G.at(at, 0) > -0.999, G.periodic(_vector(3, 0, 0), F.lit(0.5), F.lit(0.4), t))
    every = G.total(G.gaussian_anomaly(_vector(0, 0, 0), _vector(5, 0, 0), F.lit(2.0), at), wave, G.gradient(F.array(_vector(0.1, 0.2, 0), _vector(0, 0, 0), _vector(0, 0, 0)), at))
    return places(spark, sf_dir).select("event_id", F.round(G.at(every, 0), 6).alias("bx"))


@query("SELECT event_id, 1000000 + round_even((0.25 + event_id / 100.0 * (1 + 40 * 1e-6)) * 1e6, 0)::BIGINT AS micros FROM events")
def node_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a node with its own offset and rate says that a sample was taken."""
    m = scalar.acquisition_micros(F.lit(1_000_000), F.col("event_id") / 100.0, F.lit(0.25), F.lit(40.0))
    return table(spark, sf_dir, "events").select("event_id", m.alias("micros"))


@query("SELECT event_id, round(exp(a - m) / (exp(a - m) + exp(b - m)), 6) AS first, round(CASE WHEN value < 1 THEN 0 ELSE 10 * log10(value / 2.0) END, 6) AS snr FROM (SELECT *, greatest(a, b) AS m FROM (SELECT event_id, value, value / 50 AS a, 2.0::DOUBLE AS b FROM events))")
def softmax_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first of two scores, and a ratio of powers in dB."""
    p = scalar.softmax(F.array(F.col("value") / 50, F.lit(2.0)))
    snr = F.when(F.col("value") < 1, scalar.snr_db(F.lit(0.0), F.lit(0.0))).otherwise(scalar.snr_db(F.col("value"), F.lit(2.0)))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.get(p, F.lit(0)), 6).alias("first"), F.round(snr, 6).alias("snr"))


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 600")
def last_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.newest(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 600)


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, frame_id, greatest(top - 20, 0) AS overwritten FROM (SELECT *, max(frame_id) OVER (PARTITION BY user_id) AS top FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_id FROM events)) WHERE frame_id > top - 20")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty frames of each session, and how many were overwritten."""
    from .series import series

    f = series(spark, sf_dir).select(F.col("sensor").cast("string").alias("session_id"), (F.col("i") + 1).alias("frame_id"))
    return recent(f, 20)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.repeated(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT c_custkey AS k, 'high' AS side FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_custkey, 'low' FROM customer WHERE c_acctbal < -900")
def union_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    pick = lambda f, side: c.filter(f).select(F.col("c_custkey").alias("k"), F.lit(side).alias("side"))
    return datasets.union([pick("c_acctbal > 9000", "high"), pick("c_acctbal < -900", "low")])


@query("SELECT doc_id AS observation_id, quality FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 = 0 AND n_chars % 2 = 0")
def review_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved entries with the observation and the label of the same content; reviews of other content don't join."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("observation_id"), F.sha2("text", 256).alias("content_digest"), "n_chars")
    seen = F.when(F.col("n_chars") % 2 == 0, F.col("content_digest")).otherwise("stale")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "observation_id").join(d, "observation_id").select("observation_id", seen.alias("content_digest"), "quality")
    entries = d.filter("observation_id % 3 = 0").select("observation_id", "content_digest")
    return datasets.approved(d, labels, entries).select("observation_id", "quality")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_custkey % 5 < 3 THEN 'TRAIN' ELSE 'TEST' END AS split FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def lineage_inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the split of their order's lineage."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lineage_id"), F.when(F.col("o_custkey") % 5 < 3, "TRAIN").otherwise("TEST").alias("split"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lineage_id"), "l_linenumber")
    return J.inherit_split(lines, own).select(F.col("lineage_id").alias("l_orderkey"), "l_linenumber", "split")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def strict_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties read by a schema that allows no other key."""
    return table(spark, sf_dir, "events").select("event_id", strict_json(F.col("props"), "k int", ["k"])["k"].alias("k"))


@query("SELECT event_type, stddev_pop(value) > 1e-9 OR stddev_pop(user_id) > 1e-9 AS diverse FROM events WHERE event_type = 'view' GROUP BY 1")
def reference_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rows of a reference span more than a point."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'view'").select("value", F.col("user_id").cast("double").alias("user"))
    return spark.createDataFrame([("view", S.diverse(rows, ["value", "user"]))], "event_type string, diverse boolean")


@query(f"WITH h AS (SELECT event_id, (user_id % 12) * {pi / 12} AS a FROM events) SELECT event_id, round(CASE WHEN cos(a) * 0.6 - sin(a) * 0.8 < 0 THEN -1 ELSE 1 END * (cos(a) * 0.6 - sin(a) * 0.8), 6) AS w FROM h")
def quaternion_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of two turns about one axis, with w not negative."""
    half = (F.col("user_id") % 12) * (pi / 12)
    q = G.canonical(G.quaternion_product(F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)), _vector(0.6, 0, 0, 0.8)))
    return table(spark, sf_dir, "events").select("event_id", F.round(G.at(q, 0), 6).alias("w"))
