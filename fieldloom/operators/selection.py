"""Splits, banks, cursors and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import ranked, small


def lot(id: str, seed: int) -> Column:  # noqa: A002
    """A seeded order of ids that any executor recomputes."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))


def lineage_split(rows: DataFrame, lineage: str, label: str, seed: int, shares: tuple[float, float] = (0.6, 0.2), by: Column | None = None) -> DataFrame:
    """rows with `split`: lineages of each label in seeded order, the first share to TRAIN, the next to VALIDATION.

    by: what orders them instead (a content digest, say), the same for all rows of a lineage.
    """
    own = rows.select(lineage, label, (lot(lineage, seed) if by is None else by).alias("_lot")).distinct()
    placed = ranked(own, [label], [F.col("_lot"), F.col(lineage)], "_at")
    n = small(own.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")))
    a, b = F.rint(F.col("_n") * shares[0]), F.rint(F.col("_n") * (shares[0] + shares[1]))
    split = F.when(F.col("_at") < a, "TRAIN").when(F.col("_at") < b, "VALIDATION").otherwise("TEST")
    named = placed.join(n, placed[label].eqNullSafe(n["_label"])).select(lineage, label, split.alias("split"))
    return rows.join(named, [lineage, label])


def balanced_bank(rows: DataFrame, id: str, label: str, each: int, seed: int) -> DataFrame:  # noqa: A002
    """`each` rows of every label, by seeded order."""
    w = Window.partitionBy(label).orderBy(lot(id, seed), id)
    return rows.withColumn("ordinal", F.row_number().over(w) - 1).filter(F.col("ordinal") < each)


def page(frames: DataFrame, after: int, limit: int, frame: str = "frame_id") -> DataFrame:
    """The next `limit` frames after a cursor, each with `gap`: frames before them are gone."""
    oldest = frames.agg((F.min(frame) - 1 > after).alias("gap"))
    return frames.filter(F.col(frame) > after).orderBy(frame).limit(min(limit, 1000)).join(F.broadcast(oldest))


def newest(rows: DataFrame, frame: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(frame)).limit(n)


def strongest(rows: DataFrame, label: str, score: str, each: int, id: str) -> DataFrame:  # noqa: A002
    w = Window.partitionBy(label).orderBy(F.desc(F.abs(score)), score, id)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= each)


def by_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with a content digest, the order a seeded split starts from."""
    return rows.withColumn("digest", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def balance(rows: DataFrame, by: list[str], low: int, high: int) -> DataFrame:
    """Design cells whose count is outside [low, high]."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).filter((F.col("n") < low) | (F.col("n") > high))
