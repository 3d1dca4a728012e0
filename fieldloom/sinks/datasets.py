"""Writers: immutable datasets, reports, an append-only ledger, a review store, a stream sink."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import create_text, read_text


MANIFEST = "manifest.json"


def write_dataset(channels: dict[str, DataFrame], path: str) -> dict:
    """All channels (observations, labels, ...) or none, each in a folder of its own, by split; the manifest, which is returned.

    Folders are written first; the manifest that names them, with rows, schema and digest of each, is created last and
    only if there is none.  So a broken attempt is no dataset, and a dataset is never overwritten.
    """
    spark, top = next(iter(channels.values())).sparkSession, path.rstrip("/")
    if read_text(spark, f"{top}/{MANIFEST}") is not None:
        raise FileExistsError(f"a dataset is never overwritten: {path}")
    attempt, listed = f"data-{uuid.uuid4().hex}", {}
    for name, rows in channels.items():
        out = rows.write.mode("errorifexists")
        (out.partitionBy("split") if "split" in rows.columns else out).parquet(f"{top}/{attempt}/{name}")
        made = spark.read.schema(rows.schema).parquet(f"{top}/{attempt}/{name}")
        listed[name] = {"folder": f"{attempt}/{name}", "rows": made.count(), "schema": rows.schema.jsonValue(), "digest": content_digest(made)}
    manifest = {"channels": listed}
    create_text(spark, f"{top}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
    return manifest


def read_dataset(spark: SparkSession, path: str, channel: str, split: str | None = None, verify: bool = True) -> DataFrame:
    """A channel of a dataset, or one split of it (the others' files are not opened).

    Only what the manifest lists is read, by its schema; verify: its rows must have the manifest's number and digest.
    """
    top = path.rstrip("/")
    listed = json.loads(read_text(spark, f"{top}/{MANIFEST}") or '{"channels": {}}')["channels"]
    if channel not in listed:
        raise KeyError(f"the manifest lists no {channel!r}")
    own = listed[channel]
    rows = spark.read.schema(T.StructType.fromJson(own["schema"])).parquet(f"{top}/{own['folder']}")
    if verify and (rows.count() != own["rows"] or content_digest(rows) != own["digest"]):
        raise ValueError(f"{channel!r} is not what was published")
    return rows if split is None else rows.filter(F.col("split") == split)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, an inventory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def content_digest(rows: DataFrame) -> str:
    """SHA-256 of a table's rows whatever their order: from sums of row hashes, so nothing is collected."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(5)]
    found = rows.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(json.dumps([rows.dtypes and sorted(rows.dtypes), *map(str, found)]).encode()).hexdigest()


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A small report as one file."""
    out = rows.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


#: Steps of a sealed evaluation, each once and in this order.
STEPS = ("sealed", "observations_opened", "labels_opened", "evaluation_published")
LEDGER = "sequence long, event string, details string, previous string, entry string"


class Ledger:
    """Append-only chain of entries; an entry's digest covers the one before."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/*") if self._n() else self.spark.createDataFrame([], LEDGER)

    def _n(self) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return len(fs.listStatus(folder)) if fs.exists(folder) else 0

    def append(self, event: str, **details: object) -> None:
        n = self._n()
        if n >= len(STEPS) or event != STEPS[n]:
            raise ValueError(f"{event!r} can't follow {STEPS[n - 1] if n else 'nothing'!r}")
        last = self.rows().orderBy(F.desc("sequence")).first()
        previous, said = (last.entry if last else "0" * 64), json.dumps(details, sort_keys=True)
        entry = hashlib.sha256(f"{n}|{event}|{said}|{previous}".encode()).hexdigest()
        self.spark.createDataFrame([(n, event, said, previous, entry)], LEDGER).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/{n:06d}")

    def broken(self) -> DataFrame:
        """Entries whose digest or link is wrong."""
        w = Window.orderBy("sequence")
        linked = self.rows().withColumn("_before", F.coalesce(F.lag("entry").over(w), F.lit("0" * 64)))
        own = F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "event", "details", "previous"), 256)
        return linked.filter((F.col("previous") != F.col("_before")) | (F.col("entry") != own)).drop("_before")


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key isn't there yet: repeats change nothing, a known key with other content is an error."""
    try:
        there = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = rows.filter("false")
    content = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256).alias("content"))
    clash = content(rows).unionAll(content(there)).groupBy(key).agg(F.countDistinct("content").alias("n")).filter("n > 1").select(key).limit(1).collect()
    if clash:
        raise ValueError(f"{key} {clash[0][0]!r} is there with other content")
    rows.dropDuplicates([key]).join(there.select(key), key, "left_anti").select(*rows.columns).write.mode("append").parquet(path)


def approved(observations: DataFrame, labels: DataFrame, entries: DataFrame) -> DataFrame:
    """Observations with the label that was reviewed for exactly this content, in a collection."""
    return entries.join(observations, ["observation_id", "content_digest"]).join(labels, ["observation_id", "content_digest"])


def foreach_batch(path: str, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A stream sink that writes each micro-batch once, under its number: a replayed batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
        if then:
            then(batch, number)

    return sink


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size or digest differ between two inventories (path, bytes, sha256), or that one lacks."""
    a, b = (x.select("path", F.struct("bytes", "sha256").alias(n)) for x, n in ((before, "was"), (after, "now")))
    return a.join(b, "path", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
