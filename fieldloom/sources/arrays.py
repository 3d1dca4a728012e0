"""Partitions of .npy arrays as a Spark data source, `loom_arrays`, for reading and writing.

A dataset is a manifest and folders of parts; a part is a run of rows of one split with
a .npy file for each column, whose first dimension is the rows.  The manifest says each
column's type and the rest of its shape, and each part's split, rows and the SHA-256 of
its files.  It is written last and never over another one, so a broken attempt is no
dataset.

Reading: a part is an input partition.  Splits may be named, or a filter on `split` (=,
in) pushed down; parts of other splits are not opened.  Only files that the manifest lists are read; one
whose digest, type or shape is not the manifest's, or whose numbers are not finite,
fails the job.  Nothing is unpickled.

Files are opened through pyarrow's file systems; every executor must see the path.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

NAME, MANIFEST = "loom_arrays", "manifest.json"
#: Rows of a part.
ROWS = 4096
#: Types of numbers, as Spark and NumPy name them.
KINDS = {"double": "<f8", "bigint": "<i8", "int": "<i4", "boolean": "|b1"}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def _shape(kind: T.DataType) -> tuple[str, int]:
    """Type of the numbers and how often they are nested."""
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    if kind.simpleString() not in KINDS:
        raise TypeError(f"no array type for {kind.simpleString()}")
    return kind.simpleString(), depth


def _nested(values: np.ndarray) -> pa.Array:
    """Rows of an array as lists of lists."""
    out = pa.array(np.ascontiguousarray(values).ravel())
    for k in range(values.ndim - 1, 0, -1):
        n = int(np.prod(values.shape[:k]))
        out = pa.ListArray.from_arrays(np.arange(0, n + 1, dtype=np.int32) * values.shape[k], out)
    return out


def _stacked(column: pa.Array, name: str, kind: str, depth: int) -> np.ndarray:
    """An Arrow column as one array; rows of different shapes or with nulls are refused."""
    shape, flat = [len(column)], column
    for _ in range(depth):
        if flat.null_count:
            raise ValueError(f"{name}: a null is no array")
        sizes = np.unique(flat.value_lengths().to_numpy())
        if len(sizes) > 1:
            raise ValueError(f"{name}: rows have several shapes")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        flat = flat.flatten()
    if flat.null_count:
        raise ValueError(f"{name}: a null is no number")
    return flat.to_numpy(zero_copy_only=False).astype(KINDS[kind]).reshape(shape)


@dataclass
class Part(InputPartition):
    split: str
    folder: str
    rows: int
    files: dict[str, str]

    def __init__(self, split: str, folder: str, rows: int, files: dict[str, str]) -> None:
        super().__init__(folder)
        self.split, self.folder, self.rows, self.files = split, folder, rows, files


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, manifest: dict, splits: set[str] | None = None) -> None:
        self.path, self.manifest, self.splits = path, manifest, splits

    def partitions(self) -> list[InputPartition]:
        return [Part(**p) for p in self.manifest["parts"] if self.splits is None or p["split"] in self.splits]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Part):  # a manifest without such parts
            return
        files, top = _opened(self.path)
        columns = {}
        for name, kind in self.manifest["columns"].items():
            raw = files.open_input_stream(f"{top}/{partition.folder}/{name}.npy").read()
            if hashlib.sha256(raw).hexdigest() != partition.files[name]:
                raise ValueError(f"{partition.folder}/{name}.npy is not what the manifest says")
            values = np.load(io.BytesIO(raw), allow_pickle=False)
            if values.dtype.str != KINDS[kind["kind"]] or list(values.shape) != [partition.rows, *kind["shape"]]:
                raise ValueError(f"{partition.folder}/{name}.npy has type {values.dtype.str} and shape {values.shape}")
            if values.dtype.kind == "f" and not np.isfinite(values).all():
                raise ValueError(f"{partition.folder}/{name}.npy has numbers that are not finite")
            columns[name] = _nested(values)
        split = pa.array([partition.split] * partition.rows, pa.string())
        yield pa.RecordBatch.from_arrays([split, *columns.values()], ["split", *columns])


class PushingReader(ArrayReader):
    """For sessions that push filters to Python sources; in others Spark refuses a reader that takes any."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("split",) else set(f.value) if isinstance(f, In) and f.attribute == ("split",) else None
            if wanted is None:
                yield f
            else:
                self.splits = wanted if self.splits is None else self.splits & wanted


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]
    shapes: dict[str, list[int]]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.attempt = path, f"data-{uuid.uuid4().hex}"
        self.columns = {f.name: _shape(f.dataType) for f in schema.fields if f.name != "split"}
        if "split" not in schema.names:
            raise ValueError("rows have no split")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = _opened(self.path)
        held: dict[str, list[pa.RecordBatch]] = {}
        parts, shapes = [], {}

        def flush(split: str) -> None:
            rows = pa.Table.from_batches(held.pop(split)).combine_chunks()
            folder, digests = f"{self.attempt}/{split}/{uuid.uuid4().hex}", {}
            files.create_dir(f"{top}/{folder}")
            for name, (kind, depth) in self.columns.items():
                values = _stacked(rows[name].combine_chunks() if isinstance(rows[name], pa.ChunkedArray) else rows[name], name, kind, depth)
                if shapes.setdefault(name, list(values.shape[1:])) != list(values.shape[1:]):
                    raise ValueError(f"{name}: rows have several shapes")
                raw = io.BytesIO()
                np.save(raw, values, allow_pickle=False)
                digests[name] = hashlib.sha256(raw.getvalue()).hexdigest()
                with files.open_output_stream(f"{top}/{folder}/{name}.npy") as out:
                    out.write(raw.getvalue())
            parts.append({"split": split, "folder": folder, "rows": rows.num_rows, "files": digests})

        for batch in iterator:
            names = batch.column(batch.schema.get_field_index("split"))
            if names.null_count:
                raise ValueError("a row has no split")
            for split in names.unique().to_pylist():
                own = batch.filter(pc.equal(names, split))
                for at in range(0, own.num_rows, ROWS):
                    held.setdefault(split, []).append(own.slice(at, ROWS))
                    if sum(b.num_rows for b in held[split]) >= ROWS:
                        flush(split)
        for split in list(held):
            flush(split)
        return Written(parts, shapes)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        shapes: dict[str, list[int]] = {}
        for m in told:
            for name, shape in m.shapes.items():
                if shapes.setdefault(name, shape) != shape:
                    raise ValueError(f"{name}: rows have several shapes")
        columns = {name: {"kind": kind, "shape": shapes.get(name, [0] * depth)} for name, (kind, depth) in self.columns.items()}
        files, top = _opened(self.path)
        files.create_dir(top)
        if files.get_file_info(f"{top}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"a dataset is never overwritten: {self.path}")
        mine = f"{top}/{self.attempt}.json"
        with files.open_output_stream(mine) as out:
            out.write(json.dumps({"columns": columns, "parts": sorted((p for m in told for p in m.parts), key=lambda p: p["folder"])}, sort_keys=True).encode())
        files.move(mine, f"{top}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        files, top = _opened(self.path)
        if files.get_file_info(f"{top}/{self.attempt}").type != fs.FileType.NotFound:
            files.delete_dir(f"{top}/{self.attempt}")


class ArraySource(DataSource):
    """Options: path, the dataset's folder; splits, a JSON list of those to read; pushes, whether the session pushes filters."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _manifest(self) -> dict:
        files, top = _opened(self.options["path"])
        return json.loads(files.open_input_stream(f"{top}/{MANIFEST}").read())

    def schema(self) -> T.StructType:
        fields = [T.StructField("split", T.StringType())]
        for name, kind in self._manifest()["columns"].items():
            t = {"double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}[kind["kind"]]
            for _ in kind["shape"]:
                t = T.ArrayType(t)
            fields.append(T.StructField(name, t))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> ArrayReader:
        named = self.options.get("splits")
        kind = PushingReader if self.options.get("pushes") == "true" else ArrayReader
        return kind(self.options["path"], self._manifest(), set(json.loads(named)) if named else None)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], schema)


#: The session's own setting.
PUSHES = "spark.sql.python.filterPushdown.enabled"


def _register(spark: SparkSession) -> None:
    try:
        spark.dataSource.register(ArraySource)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def write_arrays(rows: DataFrame, path: str) -> None:
    """rows (split, numbers and nested arrays of them) as a dataset of arrays."""
    _register(rows.sparkSession)
    rows.write.format(NAME).mode("append").option("path", path).save()


def read_arrays(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """Rows of a dataset, or of some splits; the others' files are not opened.

    Where the session pushes filters to Python sources, a filter on split does the same.
    """
    _register(spark)
    out = spark.read.format(NAME).option("path", path).option("pushes", str(spark.conf.get(PUSHES, "false")).lower())
    return (out if splits is None else out.option("splits", json.dumps(splits))).load()


def recomputed(rows: DataFrame, stored: str, again: Column, tolerance: float = 1e-9) -> DataFrame:
    """rows with `matches`: whether what a file holds is what its other arrays give again."""
    near = F.forall(F.zip_with(stored, again, lambda a, b: F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.abs(b), F.lit(1.0)), F.lit(False))), lambda x: x)
    return rows.withColumn("matches", near & (F.size(stored) == F.size(again)))
