"""Queries through datasets of arrays and nested configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W
from ..registry import query
from ..shared import shared_folder
from ..sources import arrays
from ..sources import configurations as C
from ..sources.tables import table
from .series import FEATURES, anomalies


@query(f"WITH {FEATURES} SELECT 'TRAIN' AS split, sensor, s, round(f0, 6) AS f0, round(f2, 6) AS f2, true AS matches FROM f WHERE sensor % 5 < 3")
def array_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and features written as .npy partitions, read back for one split, features held against the windows'."""
    a = F.col("a")
    made = anomalies(spark, sf_dir).filter("a is not null").select(F.when(F.col("sensor") % 5 < 3, "TRAIN").when(F.col("sensor") % 5 == 3, "VALIDATION").otherwise("TEST").alias("split"), F.col("sensor").cast("long").alias("sensor"), F.col("s").cast("long").alias("s"), "a", F.array(W.mean(a), W.slope(a, 1.0)).alias("features"))
    path = shared_folder(spark)
    arrays.write_arrays(made, path)
    rows = arrays.read_arrays(spark, path, ["TRAIN"])
    checked = arrays.recomputed(rows, "features", F.array(W.mean(a), W.slope(a, 1.0)))
    return checked.select("split", "sensor", "s", F.round(F.get("features", F.lit(0)), 6).alias("f0"), F.round(F.get("features", F.lit(1)), 6).alias("f2"), "matches")


SPEC = C.Record({
    "session_name": C.Text(nonempty=True), "random_seed": C.Number(0, 2**32 - 1, integer=True), "sampling_rate_Hz": C.Number(0, 2000, above=True), "ui_refresh_rate_Hz": C.Number(0, 60, above=True),
    "nodes": C.Items(C.Record({"sensor_id": C.Text(nonempty=True), "bandwidth_Hz": C.Number(0, above=True, nullable=True), "mode": C.Text(one_of=("vector", "monoaxial", "total_field"))}, optional=("mode",)), 1, 8, unique="sensor_id"),
    "props": C.Record({"k": C.Number(0, 99, integer=True)}), "paused": C.Flag(),
}, optional=("paused",))
RULES = [
    C.Rule("refresh above sampling", lambda v: C.number(v, "$.ui_refresh_rate_Hz") > C.number(v, "$.sampling_rate_Hz")),
    C.Rule("bandwidth not below half the sampling rate", lambda v: F.exists(F.transform(F.try_variant_get(v, "$.nodes", "array<variant>"), lambda n: C.number(n, "$.bandwidth_Hz")), lambda b: b * 2 >= C.number(v, "$.sampling_rate_Hz"))),
]
#: Every event's configuration, most of them wrong in one way or another; the same expression in both dialects.
TEXT = """CASE WHEN m = 12 THEN '{"session_name":' WHEN m = 11 THEN '[1]' ELSE concat('{"session_name":"', CASE WHEN m = 1 THEN ' ' ELSE 's' END, '","random_seed":', CASE WHEN m = 2 THEN '-1' WHEN m = 3 THEN '1.5' WHEN m = 10 THEN '"7"' ELSE CAST(user_id AS STRING) END,
 ',"sampling_rate_Hz":', CASE WHEN m = 4 THEN '0' WHEN m = 7 THEN 'null' ELSE '100' END, CASE WHEN m = 13 THEN '' ELSE concat(',"ui_refresh_rate_Hz":', CASE WHEN m = 5 THEN '200' ELSE '10' END) END,
 ',"nodes":[{"sensor_id":"a","bandwidth_Hz":', CASE WHEN m = 6 THEN '60' WHEN m = 8 THEN 'null' ELSE '20' END, '},{"sensor_id":"', CASE WHEN m = 8 THEN 'a' ELSE 'b' END, '"', CASE WHEN m = 9 THEN ',"gain":1,"mode":"scalar"' ELSE '' END, ',"bandwidth_Hz":20}]',
 ',"props":', props, CASE WHEN m = 0 THEN ',"extra":true,"paused":"no"' ELSE '' END, '}') END"""
_NODE = """CASE WHEN NOT json_exists(j, '$.nodes[{0}].sensor_id') THEN 'configuration.nodes[{0}].sensor_id: missing' WHEN trim(json_extract_string(j, '$.nodes[{0}].sensor_id')) = '' THEN 'configuration.nodes[{0}].sensor_id: empty' END,
 CASE WHEN json_type(j, '$.nodes[{0}].bandwidth_Hz') <> 'NULL' AND json_extract(j, '$.nodes[{0}].bandwidth_Hz')::DOUBLE <= 0 THEN 'configuration.nodes[{0}].bandwidth_Hz: out of range' END,
 CASE WHEN json_extract_string(j, '$.nodes[{0}].mode') NOT IN ('vector', 'monoaxial', 'total_field') THEN 'configuration.nodes[{0}].mode: not allowed' END"""
_FAULTS = f"""WITH t AS (SELECT event_id, {TEXT} AS t FROM (SELECT *, event_id % 14 AS m FROM events)), j AS (SELECT event_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM t),
x AS (SELECT event_id, CASE WHEN j IS NULL THEN ['configuration: no JSON'] WHEN json_type(j) <> 'OBJECT' THEN ['configuration: not a record'] ELSE list_concat(
 list_transform(list_filter(json_keys(j), lambda k: k NOT IN ('session_name', 'random_seed', 'sampling_rate_Hz', 'ui_refresh_rate_Hz', 'nodes', 'props', 'paused')), lambda k: 'configuration.' || k || ': unknown'),
 list_transform(list_filter(json_keys(j, '$.props'), lambda k: k <> 'k'), lambda k: 'configuration.props.' || k || ': unknown'),
 list_transform(list_filter(list_distinct(json_keys(j, '$.nodes[1]')), lambda k: k NOT IN ('sensor_id', 'bandwidth_Hz', 'mode')), lambda k: 'configuration.nodes[1].' || k || ': unknown'),
 [CASE WHEN trim(json_extract_string(j, '$.session_name')) = '' THEN 'configuration.session_name: empty' END,
 CASE WHEN json_type(j, '$.random_seed') = 'VARCHAR' THEN 'configuration.random_seed: not a number' WHEN json_type(j, '$.random_seed') = 'DOUBLE' THEN 'configuration.random_seed: not an integer' WHEN json_extract(j, '$.random_seed')::DOUBLE < 0 THEN 'configuration.random_seed: out of range' END,
 CASE WHEN json_type(j, '$.sampling_rate_Hz') = 'NULL' THEN 'configuration.sampling_rate_Hz: null' WHEN json_extract(j, '$.sampling_rate_Hz')::DOUBLE <= 0 THEN 'configuration.sampling_rate_Hz: out of range' END,
 CASE WHEN NOT json_exists(j, '$.ui_refresh_rate_Hz') THEN 'configuration.ui_refresh_rate_Hz: missing' WHEN json_extract(j, '$.ui_refresh_rate_Hz')::DOUBLE > 60 THEN 'configuration.ui_refresh_rate_Hz: out of range' END,
 {_NODE.format(0)}, {_NODE.format(1)}, CASE WHEN json_extract_string(j, '$.nodes[0].sensor_id') = json_extract_string(j, '$.nodes[1].sensor_id') THEN 'configuration.nodes: repeated sensor_id' END,
 CASE WHEN json_exists(j, '$.paused') AND json_type(j, '$.paused') <> 'BOOLEAN' THEN 'configuration.paused: not a flag' END,
 CASE WHEN json_extract(j, '$.props.k')::DOUBLE NOT BETWEEN 0 AND 99 THEN 'configuration.props.k: out of range' END,
 CASE WHEN TRY_CAST(json_extract(j, '$.ui_refresh_rate_Hz') AS DOUBLE) > TRY_CAST(json_extract(j, '$.sampling_rate_Hz') AS DOUBLE) THEN 'configuration: refresh above sampling' END,
 CASE WHEN greatest(TRY_CAST(json_extract(j, '$.nodes[0].bandwidth_Hz') AS DOUBLE), TRY_CAST(json_extract(j, '$.nodes[1].bandwidth_Hz') AS DOUBLE)) * 2 >= TRY_CAST(json_extract(j, '$.sampling_rate_Hz') AS DOUBLE) THEN 'configuration: bandwidth not below half the sampling rate' END]) END AS f FROM j)
SELECT event_id, array_to_string(list_sort(list_filter(f, lambda s: s IS NOT NULL)), '; ') AS faults FROM x"""


@query(_FAULTS)
def configuration_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faults of nested configurations, by path.

    A row costs far more work than bytes, so rows are dealt to all cores instead of by the files' splits.
    """
    dealt = table(spark, sf_dir, "events").select("event_id", "user_id", "props").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    rows = dealt.withColumn("m", F.col("event_id") % 14)
    return rows.select("event_id", F.array_join(C.faults(F.expr(TEXT), SPEC, RULES), "; ").alias("faults"))
