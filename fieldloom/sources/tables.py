"""Readers with fixed schemas: driver tables, observation frames, labels, feature matrices, strict configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READING = "struct<sensor_id:string,sequence_id:bigint,acquisition_time:timestamp,arrival_time:timestamp,measurement_mode:string,value_T:double,components_T:array<double>,saturation_mask:array<boolean>,quality_flags:array<string>,valid:boolean,observed_temperature_K:double,position_m:array<double>,orientation_world_to_sensor_wxyz:array<double>,calibration_version:string>"
FRAME = f"session_id string, configuration_version int, frame_id bigint, sim_time_s double, readings array<{READING}>"
LABEL = "episode_id string, generative_lineage_id string, partition string, event_start_s double, local_label string, network_label string"
MATRIX = ", ".join(f"f{i} double" for i in range(8)) + ", label int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames from JSON lines; a record that doesn't fit the schema fails the job."""
    return spark.read.schema(FRAME).option("mode", "FAILFAST").json(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """The label channel, apart from observations."""
    return spark.read.schema(LABEL).option("mode", "FAILFAST").json(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """CSV of eight features and a label of -1 or 1; other labels and non-finite features are refused."""
    rows = spark.read.schema(MATRIX).option("header", True).option("mode", "FAILFAST").csv(path)
    bad = ~F.col("label").isin(-1, 1)
    for i in range(8):
        bad |= F.col(f"f{i}").isNull() | F.isnan(f"f{i}") | (F.abs(f"f{i}") == float("inf"))
    return rows.withColumn("label", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a row has no finite features or a label that is not -1 or 1")).cast("int")).otherwise(F.col("label")))


def strict_json(text: Column, schema: str, keys: list[str]) -> Column:
    """A struct from JSON; unknown keys and text that is not JSON raise an error."""
    unknown = F.array_except(F.json_object_keys(text), F.array(*map(F.lit, keys)))
    parsed = F.from_json(text, schema, {"mode": "FAILFAST"})
    return F.when(F.coalesce(F.size(unknown) > 0, F.lit(True)), F.raise_error(F.concat(F.lit("unknown fields: "), F.coalesce(F.array_join(unknown, ", "), F.lit("no object"))))).otherwise(parsed)
