"""Validity of observation frames and readings.

A frame is (session_id, frame_id, sim_time_s, readings array<struct>).  Nothing
is imputed: a reading is usable or it carries flags that say why not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import world_north_nt
from ..functions.scalar import sample_index
from .scans import scan

HZ, TOLERANCE = 100.0, 1e-8
#: Flags that a device may set itself.
KNOWN = ("clipped", "signal_absent", "stuck", "clock_error")


def flags(r: Column, calibration: Column | None = None) -> Column:
    """Sorted failure flags of one reading; calibration, where known, must be the reading's."""
    own = F.coalesce(r["quality_flags"], F.array().cast("array<string>"))
    mask = r["saturation_mask"]
    clipped = mask.isNull() | F.exists(mask, lambda x: x) | F.array_contains(own, "clipped")
    tests = {
        "unsupported_measurement_mode": r["measurement_mode"] != "vector",
        "missing_vector_components": r["components_T"].isNull(),
        "reading_marked_invalid": ~r["valid"],
        "clipped": clipped,
        **{k: F.array_contains(own, k) for k in ("stuck", "clock_error", "signal_absent")},
        "unsupported_quality_flag": F.size(F.array_except(own, F.array(*map(F.lit, KNOWN)))) > 0,
        "calibration_not_declared": F.coalesce(r["calibration_version"], F.lit("")) == "",
    }
    if calibration is not None:
        tests["calibration_version_changed"] = F.coalesce(calibration != r["calibration_version"], F.lit(False))
    return F.array_sort(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()])))


def index_frames(frames: DataFrame, hz: float = HZ) -> DataFrame:
    """One frame for each index (the first), with `odd`: the index has more frames or one off the grid."""
    origin = frames.groupBy("session_id").agg(F.min("sim_time_s").alias("origin_s"))
    placed = frames.join(origin, "session_id").withColumn("i", sample_index(F.col("sim_time_s"), F.col("origin_s"), hz))
    off = F.abs(F.col("sim_time_s") - (F.col("origin_s") + F.col("i") / hz)) > TOLERANCE
    same = Window.partitionBy("session_id", "i")
    ranked = placed.withColumn("odd", F.max(off).over(same) | (F.count("*").over(same) > 1)).withColumn("_n", F.row_number().over(same.orderBy("sim_time_s", "frame_id")))
    return ranked.filter("_n = 1").drop("_n")


def order_faults(frames: DataFrame) -> DataFrame:
    """Frames whose time does not come after the frame before: a stream with any is refused, not sorted."""
    return scan(frames, ["session_id"], ["frame_id"], lag={"before_s": F.col("sim_time_s")}).filter("sim_time_s <= before_s")


def readings(indexed: DataFrame) -> DataFrame:
    """Long form: a row for each (session_id, i, sensor_id); a sensor's first reading in a frame counts."""
    long = indexed.select("session_id", "origin_s", "i", "frame_id", "odd", F.posexplode("readings").alias("_p", "r"))
    same = Window.partitionBy("session_id", "i", "r.sensor_id")
    ranked = long.withColumn("twice", F.count("*").over(same) > 1).withColumn("_n", F.row_number().over(same.orderBy("_p")))
    return ranked.filter("_n = 1").select("session_id", "origin_s", "i", "frame_id", "odd", "twice", F.col("r.sensor_id").alias("sensor_id"), "r")


def samples(long: DataFrame, calibration: Column | None = None) -> DataFrame:
    """Readings as (i, received, usable, flags, north_nt, temperature, sequence, micros)."""
    r = F.col("r")
    return long.select(
        "session_id",
        "origin_s",
        "sensor_id",
        "i",
        "odd",
        "twice",
        r["components_T"].isNotNull().alias("received"),
        flags(r, calibration).alias("flags"),
        world_north_nt(r["orientation_world_to_sensor_wxyz"], r["components_T"]).alias("x"),
        r["observed_temperature_K"].alias("temperature"),
        r["sequence_id"].alias("sequence"),
        F.unix_micros(r["acquisition_time"].cast("timestamp")).alias("micros"),
        r["calibration_version"].alias("calibration"),
    ).withColumn("usable", F.size("flags") == 0)


def even(t: Column, n: int, hz: float = HZ) -> Column:
    """Whether n structs (i, sequence, micros) have sequences one apart and clocks one period apart."""
    left, right = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
    step = round(1e6 / hz)
    sequence = F.forall(F.zip_with(left, right, lambda a, b: b["sequence"] == a["sequence"] + 1), lambda x: x)
    clock = F.forall(F.zip_with(left, right, lambda a, b: b["micros"] - a["micros"] == step), lambda x: x)
    return F.struct(((F.size(t) == n) & sequence).alias("sequence"), ((F.size(t) == n) & clock).alias("clock"))
