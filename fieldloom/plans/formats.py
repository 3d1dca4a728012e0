"""Queries on formats: digests, times, identifiers, vectors, versions."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar
from ..operators import joins as J
from ..operators import selection as K
from ..registry import query
from ..sources.tables import table


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest, substr(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 16) AS short FROM events""")
def json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a row as JSON with its names in order, and the short id."""
    d = scalar.digest("user_id", "event_type", "event_id")
    return table(spark, sf_dir, "events").select("event_id", d.alias("digest"), F.substring(d, 1, 16).alias("short"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 1000 AS age_ms FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC text of a time, read back, and its age at a moment."""
    iso = scalar.iso_utc(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", iso.alias("iso"), scalar.age_ms(scalar.from_iso(iso), F.lit("2024-02-01T00:00:00Z").cast("timestamp")).alias("age_ms"))


@query("SELECT event_id, regexp_full_match(event_type || ':' || user_id, '[a-z][a-z0-9:_-]{0,31}') AS valid, regexp_full_match(CAST(user_id AS VARCHAR), '[a-z][a-z0-9:_-]{0,31}') AS digits_valid FROM events")
def valid_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", scalar.identifier(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))).alias("valid"), scalar.identifier(F.col("user_id").cast("string")).alias("digits_valid"))


@query("""SELECT event_id, round(value, 6) AS x, value > 300 AS x_clipped, round(sqrt(value * value + 9 + user_id * user_id), 6) AS magnitude, value > 300 OR user_id > 100 AS any_clipped, round(0.6 * value + 0.8 * user_id, 6) AS along FROM events""")
def channel_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axis, the magnitude and the component along an axis of vectors, with what is clipped."""
    v = F.array(F.col("value"), F.lit(3.0), F.col("user_id").cast("double"))
    mask = F.array(F.col("value") > 300, F.lit(False), F.col("user_id") > 100)
    x, m = G.channel(v, mask, "x"), G.channel(v, mask, "magnitude")
    axis = F.array(F.lit(0.6), F.lit(0.0), F.lit(0.8))
    return table(spark, sf_dir, "events").select("event_id", F.round(x["value"], 6).alias("x"), x["clipped"].alias("x_clipped"), F.round(m["value"], 6).alias("magnitude"), m["clipped"].alias("any_clipped"), F.round(G.at(G.project(v, "monoaxial", axis), 0), 6).alias("along"))


@query("SELECT event_id, round(cos(value / 100), 6) AS w, round(sin(value / 100), 6) AS z FROM events WHERE value < 150")
def rotate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientation after two seconds of turning about z at a rate of value / 100."""
    e = table(spark, sf_dir, "events").filter("value < 150")
    q = G.integrate(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.col("value") / 100), 2.0)
    return e.select("event_id", F.round(G.at(q, 0), 6).alias("w"), F.round(G.at(q, 3), 6).alias("z"))


@query("SELECT event_id, round((c - s) / 2, 6) AS w, round((c + s) / 2, 6) AS x, round((c - s) / 2, 6) AS y, round((c + s) / 2, 6) AS z FROM (SELECT event_id, cos(value / 200) AS c, sin(value / 200) AS s FROM events WHERE value < 150)")
def rotate_tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rotate_rate, about the sensor's own x axis and from a tilted start, where the order of the product shows."""
    e = table(spark, sf_dir, "events").filter("value < 150")
    q = G.integrate(F.array(*[F.lit(0.5)] * 4), F.array(F.col("value") / 100, F.lit(0.0), F.lit(0.0)), 1.0)
    return e.select("event_id", *[F.round(G.at(q, i), 6).alias(n) for i, n in enumerate("wxyz")])


@query("SELECT event_id, round(1e9 * (cos(a) * value * 1e-9 + sin(a) * 2e-8), 6) AS north FROM (SELECT event_id, value, (user_id % 12) * pi() / 6 AS a FROM events)")
def world_north(spark: SparkSession, sf_dir: str) -> DataFrame:
    """North component in nT of fields seen by sensors turned about z."""
    half = (F.col("user_id") % 12) * (pi / 12)
    q = F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    field = F.array(F.col("value") * 1e-9, F.lit(2e-8), F.lit(4e-5))
    return table(spark, sf_dir, "events").select("event_id", F.round(G.world_north_nt(q, field), 6).alias("north"))


_ORDER = "sha256(c_custkey || '|' || c_mktsegment)"


@query(f"""WITH c AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_ORDER}, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, CASE WHEN k <= round_even(n * 0.6, 0) THEN 'TRAIN' WHEN k <= round_even(n * 0.8, 0) THEN 'VALIDATION' ELSE 'TEST' END AS split FROM c""")
def digest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that starts from the order of content digests, whatever the order of rows."""
    c = K.by_digest(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")
    return K.lineage_split(c, "c_custkey", "c_mktsegment", 0, by=F.col("digest")).select("c_custkey", "split")


@query("""WITH s AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS now FROM events WHERE event_type = 'signup')
SELECT event_id, user_id, now IS NULL OR ts > now AS accepted, 1 + sum((now IS NULL OR ts > now)::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS version FROM s""")
def scheduled_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events must lie strictly ahead of the clock; each that does makes a new version of its user's configuration."""
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    return J.scheduled(e, "user_id", "event_id", "ts").select("event_id", "user_id", "accepted", "version")
