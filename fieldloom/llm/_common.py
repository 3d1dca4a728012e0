"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import fresh, in_short_batches, lasting, let, ranked, running, shared_folder, small, stored, temporary

__all__ = ["WORD", "among", "fresh", "in_short_batches", "lasting", "let", "pieces", "ranked", "read", "running", "shared_folder", "small", "stored", "struct", "temporary", "whole"]

#: Words as the contracts define them: everything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the map that rules rows out before they are shuffled.
BITS = 1 << 24


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(column: pa.Array, most: int = 500) -> Iterator[pa.Array]:
    """A column in short runs, so that few texts at a time are Python strings."""
    for at in range(0, len(column), most):
        yield column.slice(at, most)


def struct(rows: list[tuple], kind: T.StructType) -> pa.StructArray:
    """Rows of tuples as an Arrow struct column of a Spark type."""
    kinds = to_arrow_schema(kind)
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], fields=list(kinds))


def whole(column: str) -> F.Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def among(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key (a long) is not in few: a map of BITS bits, whatever the input.

    It only spares a shuffle; the join behind it decides.  A map that few fills rules nothing out.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(BITS))
    # Spark's buckets hold bits from 1 on.
    maps = few.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    every = np.zeros(BITS // 8, np.uint8)
    for r in maps:  # BITS / 32768 at most
        every[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(batch.num_columns - 1).to_numpy()
            keep = (every[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep.astype(bool))) for c in batch.columns[:-1]], batch.schema.names[:-1])

    return rows.withColumn("bit", bit).mapInArrow(run, rows.schema)
