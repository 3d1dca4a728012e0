"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A batch of changes (insert, delete, revise) becomes signed sums per group.  A
commit writes them as a Parquet folder of its own and then one small record,
commits/<batch>, that names the folder and a digest of the sums.  The record is
the commit: it is created only if absent, so of two writers one wins, and a
folder without a record (a broken attempt) is never read.  The same batch again
counts once; the same batch with other sums is an error.  fold() adds the
committed deltas up into a snapshot, whose record lists the batches that it
covers, so replays of those are still known.  Totals are the largest snapshot
and the deltas that it doesn't cover.

Change rows: op, doc_id, source, lang, tokenizer, n_tokens, was_tokens.
insert adds n_tokens and a document, delete takes was_tokens and a document
away, revise adds n_tokens - was_tokens.  Defined cases: a null count is 0, null
source, lang and tokenizer are groups, an unknown op raises an error at commit,
groups whose sums are all zero stay out of the totals, no commits give no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from ._common import WORD, in_short_batches, shared_folder, stored, temporary, whole

GROUP = ("source", "lang", "tokenizer")


def signed(changes: DataFrame) -> DataFrame:
    """Sums of a batch of changes per group."""
    new, was = F.coalesce("n_tokens", F.lit(0)), F.coalesce("was_tokens", F.lit(0))
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))).cast("int"))
    count = F.when(op == "insert", new).when(op == "delete", -was).otherwise(new - was)
    return changes.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(count).cast("long").alias("n_tokens"))


TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """The committed deltas below one shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _records(self, kind: str) -> dict[str, dict]:
        """The whole records of a kind (commits, snapshots) by name."""
        top, out = self._path(f"{self.path}/{kind}"), {}
        for status in self._files.listStatus(top) if self._files.exists(top) else []:
            record = self._read(kind, status.getPath().getName())
            if record:
                out[status.getPath().getName()] = record
        return out

    def _read(self, kind: str, name: str) -> dict | None:
        """None if there is no such record, or only a broken one."""
        path = self._path(f"{self.path}/{kind}/{name}")
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def _record(self, kind: str, name: str, record: dict) -> bool:
        """Create a record; False if another writer's whole one is there."""
        path = self._path(f"{self.path}/{kind}/{name}")
        if self._files.exists(path):
            if self._read(kind, name):
                return False
            self._files.delete(path, False)  # what a broken attempt left
        try:
            stream = self._files.create(path, False)
        except Py4JJavaError:
            if self._read(kind, name):
                return False
            raise
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        return True

    def _write(self, sums: DataFrame) -> tuple[str, str]:
        """The folder that sums were written to, and a digest of them."""
        folder = f"data/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{folder}")
        made = self.spark.read.schema(TOTALS).parquet(f"{self.path}/{folder}")
        r = made.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*made.columns).cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(1), *made.columns).cast("decimal(38,0)")).alias("g")).first()
        return folder, f"{r.n}:{r.h}:{r.g}"

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch once; False if it was there with the same sums.  Other sums for a known batch raise an error."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch ids are letters, digits, - and _: {batch!r}")
        folder, digest = self._write(signed(changes))
        if self._record("commits", batch, {"data": folder, "digest": digest}):
            return True
        self._files.delete(self._path(f"{self.path}/{folder}"), True)
        if self._read("commits", batch)["digest"] != digest:
            raise ValueError(f"batch {batch!r} is committed with other sums")
        return False

    def fold(self) -> bool:
        """Add all committed deltas up into one snapshot; False if none is new."""
        commits, last = sorted(self._records("commits")), self._snapshot()
        if len(commits) <= len(last["covers"]):
            return False
        folder, digest = self._write(self._totals(commits, last))
        return self._record("snapshots", f"s{len(commits)}-{uuid.uuid4().hex}", {"data": folder, "digest": digest, "covers": commits})

    def _snapshot(self) -> dict:
        return max(self._records("snapshots").values(), key=lambda r: len(r["covers"]), default={"covers": []})

    def _totals(self, names: list[str], snapshot: dict) -> DataFrame:
        commits, covered = self._records("commits"), set(snapshot["covers"])
        folders = [commits[n]["data"] for n in names if n not in covered] + ([snapshot["data"]] if covered else [])
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.path}/{f}" for f in folders])
        summed = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return self._totals(sorted(self._records("commits")), self._snapshot())


def without_repeats(text: str | None) -> str | None:
    """The text without lines that it had before; None where none goes."""
    lines = (text or "").split("\n")
    kept = list(dict.fromkeys(lines))
    return None if len(kept) == len(lines) else "\n".join(kept)


def _counter(paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [tokens.encoder(p) for p in paths]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                made = [np.diff(c.encode(some.column(4))[1]) for c in coders]
                # A revised text is counted anew; None says that it is the same.
                revised = pa.array([without_repeats(t) for t in some.column(4).to_pylist()], pa.string())
                newer = [np.where(np.array(revised.is_null()), n, np.diff(c.encode(revised)[1])) for c, n in zip(coders, made, strict=True)]
                counts = pa.StructArray.from_arrays([pa.array(x) for x in made + newer], [f"{s}{k}" for s in "nr" for k in range(len(paths))])
                yield pa.RecordBatch.from_arrays([*some.columns[:4], counts], ["doc_id", "source", "lang", "n_words", "counts"])

    return run


def counts(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, n_words, tokenizer, n_tokens, n_revised: a row for each text and tokenizer version (name: file).

    n_revised: tokens of the text without repeated lines.
    """
    kinds = ", ".join(f"{s}{k}: long" for s in "nr" for k in range(len(versions)))
    read = in_short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("n_words"), "text")
    counted = read.mapInArrow(_counter(list(versions.values())), f"doc_id long, source string, lang string, n_words long, counts struct<{kinds}>")
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"counts.n{k}").alias("n_tokens"), F.col(f"counts.r{k}").alias("n_revised")) for k, v in enumerate(versions)])
    return counted.select("doc_id", "source", "lang", "n_words", F.inline(each))


def report(docs: DataFrame, first: dict[str, str], second: dict[str, str], least: int = 50) -> DataFrame:
    """Totals after the changes of a corpus' life, over all documents.

    load inserts every document with the first versions' counts and is sent
    again; edit revises those whose repeated lines were dropped; takedown deletes
    those of fewer than `least` words.  A snapshot folds these.  Then add inserts
    what is left with the second versions' counts, and takedown is replayed.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, shared_folder(spark))
    change = lambda df, op, n, was: df.select(F.lit(op).alias("op"), "doc_id", *GROUP, F.expr(n).cast("long").alias("n_tokens"), F.expr(was).cast("long").alias("was_tokens"))
    with temporary(spark):
        both = stored(counts(docs, first | second))
        old, new, short = both.filter(F.col("tokenizer").isin(*first)), both.filter(F.col("tokenizer").isin(*second)), F.col("n_words") < least
        takedown = change(old.filter(short), "delete", "null", "n_revised")
        rollup.commit("load", change(old, "insert", "n_tokens", "null"))
        rollup.commit("load", change(old, "insert", "n_tokens", "null"))
        rollup.commit("edit", change(old.filter("n_revised <> n_tokens"), "revise", "n_revised", "n_tokens"))
        rollup.commit("takedown", takedown)
        rollup.fold()
        rollup.commit("add", change(new.filter(~short), "insert", "n_revised", "null"))
        rollup.commit("takedown", takedown)
    return rollup.totals()
