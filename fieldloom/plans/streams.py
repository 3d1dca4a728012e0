"""The newest-window stream over frames made of `events`, delivery by delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..shared import shared_folder
from ..streaming import state8 as stream
from .frames import _E, _WIN, HOP, REF, SHAPE, SIZE, frames

#: Frames of a delivery; where every fifth session restarts its frames under a new version, and where another loses one.
ARRIVAL, RESTART, LOST = 50, 70, 160


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the delivery they come in; some sessions restart behind frame RESTART, some lack frame LOST + 1."""
    made = frames(spark, sf_dir)
    kind, i = F.col("session_id").cast("int") % 5, F.col("frame_id") - 1
    again = (kind == 3) & (i >= RESTART)
    shift = F.when(again, RESTART).otherwise(0)
    rows = made.filter(~((kind == 4) & (i == LOST))).withColumn("delivery", F.floor(i / ARRIVAL).cast("int")).withColumn("configuration_version", F.when(again, 2).otherwise(1))
    return rows.withColumns({"frame_id": F.col("frame_id") - shift, "sim_time_s": F.col("sim_time_s") - shift / SHAPE["hz"]})


_SEEN = f"""e AS (SELECT session || '/' || epoch AS session, sensor, i - epoch * {RESTART} AS i, i AS arrived, x, k, flags FROM (SELECT *, CASE WHEN session::INT % 5 = 3 AND i >= {RESTART} THEN 1 ELSE 0 END AS epoch FROM e0) WHERE NOT (session::INT % 5 = 4 AND i = {LOST}))"""
_BATCH = _WIN.replace("e AS (", "e0 AS (", 1).replace("FROM events),", f"FROM events),\n{_SEEN},", 1)
_STREAM = f"""WITH {_BATCH},
told AS (SELECT session, (session LIKE '%/0' AND split_part(session, '/', 1)::INT % 5 = 4 AND max(arrived) > {LOST}) AS breaks, arrived // {ARRIVAL} AS delivery, max(i) + 1 AS n FROM e GROUP BY session, arrived // {ARRIVAL}
 ), fails AS (SELECT session, min(delivery) AS delivery FROM told WHERE breaks GROUP BY session),
due AS (SELECT session, {REF} + (n - {SIZE} - {REF}) // {HOP} * {HOP} AS s FROM told LEFT JOIN fails USING (session) WHERE n >= {REF + SIZE} AND (fails.delivery IS NULL OR told.delivery < fails.delivery) GROUP BY ALL),
seen AS (SELECT session, s, (s - {REF}) // {HOP} + 1 - row_number() OVER (PARTITION BY session ORDER BY s) AS skipped FROM due)
SELECT split_part(j.session, '/', 1) AS session, split_part(j.session, '/', 2)::INT AS epoch, j.s AS start, j.sensor, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, round(CASE WHEN whole THEN k - k0 END, 8) AS f4, round(f5, 6) AS f5, round(f6, 6) AS f6, received / {float(SIZE)} AS f7,
 whole AS valid, skipped, 'running' AS status FROM j JOIN seen USING (session, s) LEFT JOIN f USING (session, sensor, s) LEFT JOIN band USING (session, sensor, s)
UNION ALL SELECT split_part(session, '/', 1), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, coalesce((SELECT max(skipped) FROM seen WHERE seen.session = fails.session), 0), 'failed: gap before frame {LOST + 2}' FROM fails"""


@query(_STREAM)
def stream_state8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream says after each delivery: the newest window of every session, or that it failed.

    Each delivery is a run of its own that goes on from the checkpoint of the last, and reads its own folder of frames only.
    """
    top = shared_folder(spark)
    made = delivered(spark, sf_dir)
    spread = F.pmod(F.xxhash64("session_id"), F.lit(2 * spark.sparkContext.defaultParallelism))
    made.repartition("delivery", spread).write.partitionBy("delivery").parquet(f"{top}/deliveries")
    rows = spark.read.schema(made.schema).parquet(f"{top}/deliveries")
    for d in range((rows.agg(F.max("delivery")).first()[0] or 0) + 1):
        stream.arrive(rows.filter(F.col("delivery") == d).drop("delivery"), f"{top}/in", f"{top}/checkpoint", f"{top}/out", **SHAPE)
    out = spark.read.parquet(f"{top}/out")
    return out.select(F.col("session_id").alias("session"), "epoch", "start", F.col("sensor_id").alias("sensor"), *[F.round(f"f{k}", 8 if k == 4 else 6).alias(f"f{k}") for k in range(7)], "f7", "valid", "skipped", "status")
