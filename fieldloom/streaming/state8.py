"""Newest-window analysis of frame streams, with state in the stream's own store.

Per session: a value (epoch, cursor, last analysed window, counts, failure), a map
(the frozen reference of each sensor) and a list (the frames that a window may still
need; it is cut when it holds a hop more than that, so a micro-batch adds rows and
seldom rewrites them).  Phases: frames are collected until the reference is complete,
then each micro-batch analyses only the newest complete window and counts the ones it
skipped.  State is bounded by the reference's and a window's frames.

A gap in frame ids, or a time that doesn't grow, fails the session: nothing is
repaired, and frames are refused until a new epoch begins.  That is a higher
configuration version, or frame 1 again; it clears the session's state.  Frames of a
version that is over are dropped.  An idle session (no frame for `idle_s`) gives up its
frames and says so.  A stream may begin with sessions whose references are known.

Spark hands a micro-batch over in no order, so frames are taken by version and id; times
are never sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quality import HZ
from ..operators.state8 import HOP, REFERENCE, SIZE, band_ratio_db, correlation

FEATURES = [f"f{k}" for k in range(8)]
OUT = f"session_id string, epoch int, start bigint, sensor_id string, {', '.join(f'{c} double' for c in FEATURES)}, valid boolean, skipped bigint, fenced bigint, status string"
RUN = "version int, epoch int, last bigint, t double, analysed bigint, skipped bigint, fenced bigint, kept bigint, framed boolean, failed string"
FRAME = "x array<double>, k array<double>, got array<boolean>, c array<string>, names array<string>"
KNOWN = "north double, kelvin double, c string"
#: Rows that a stream may begin with: a session's cursor and the reference of its sensors.
INITIAL = "session_id string, version int, last bigint, names array<string>, north array<double>, kelvin array<double>, c array<string>"
_NOTHING = pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")], dtype=object)
#: Spark keeps lists, maps and timers in this store only.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def samples(frames: DataFrame) -> DataFrame:
    """A row per frame with what its sensors say; the validity tests are the batch ones."""
    from ..functions.geometry import world_north_nt
    from ..operators.quality import flags

    r = F.col("readings")
    each = lambda f: F.transform(r, f)
    return frames.select(
        "session_id", F.col("configuration_version").alias("version"), "frame_id", "sim_time_s", each(lambda r: r["sensor_id"]).alias("names"),
        each(lambda r: F.when(F.size(flags(r)) == 0, world_north_nt(r["orientation_world_to_sensor_wxyz"], r["components_T"]))).alias("x"),
        each(lambda r: r["observed_temperature_K"]).alias("k"), each(lambda r: r["components_T"].isNotNull()).alias("got"), each(lambda r: r["calibration_version"]).alias("c"),
    )


def _describe(x: np.ndarray, hz: float) -> list[float]:
    """Mean, robust spread, slope, band ratio, roughness and lag-one correlation of one window."""
    t = np.arange(x.shape[0]) / hz
    t -= t.mean()
    step = np.diff(x)
    return [x.mean(), 1.4826 * np.median(np.abs(x - np.median(x))), ((x - x.mean()) @ t) / (t @ t), band_ratio_db(x[None, :], hz)[0], np.sqrt((step * step).mean()), correlation(x[None, :-1], x[None, 1:])[0]]


class Newest(StatefulProcessor):
    """See the module; shape: first, size and hop in frames, hz, and idle_s or None."""

    def __init__(self, first: int = REFERENCE, size: int = SIZE, hop: int = HOP, hz: float = HZ, idle_s: float | None = None) -> None:
        self.first, self.size, self.hop, self.hz, self.idle_s = first, size, hop, hz, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.known = handle.getMapState("reference", "sensor_id string", KNOWN)
        self.frames = handle.getListState("frames", FRAME)

    def _fresh(self, version: int, epoch: int, fenced: int = 0) -> dict[str, Any]:
        self.known.clear()
        self.frames.clear()
        return {"version": version, "epoch": epoch, "last": 0, "t": None, "analysed": None, "skipped": 0, "fenced": fenced, "kept": 0, "framed": False, "failed": None}

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        run = self._fresh(int(row["version"]), 0) | {"last": int(row["last"]), "framed": True}
        for name, north, kelvin, c in zip(row["names"], row["north"], row["kelvin"], row["c"], strict=True):
            self.known.updateValue((name,), (float(north), float(kelvin), c))
        self.run.update(tuple(run.values()))

    def _reference(self, frames: list[tuple]) -> dict[str, tuple]:
        """Each sensor's means over the first frames; null unless all of it is usable and of one calibration."""
        out: dict[str, tuple] = {}
        seen: dict[str, list[tuple]] = {}
        for x, k, _, c, names in frames:
            for name, *reading in {n: (n, *r) for n, *r in reversed(list(zip(names, x, k, c, strict=True)))}.values():
                seen.setdefault(name, []).append(tuple(reading))
        for name, found in sorted(seen.items()):
            whole = len(found) == len(frames) and all(x is not None and x == x for x, _, _ in found) and len({c for _, _, c in found}) == 1
            out[name] = (float(np.mean([x for x, _, _ in found])), float(np.mean([k for _, k, _ in found])), found[0][2]) if whole else (None, None, None)
        return out

    def _window(self, name: str, known: tuple, window: list[tuple]) -> list:
        """f0 to f7 and whether all of them are there; f7 always is."""
        found = []
        for x, k, got, c, names in window:
            at = list(names).index(name) if name in names else None
            found.append((None, None, False, None) if at is None else (x[at], k[at], bool(got[at]), c[at]))
        share = sum(g for _, _, g, _ in found) / self.size
        if known[0] is None or any(x is None or x != x or c != known[2] for x, _, _, c in found):
            return [None] * 7 + [share, False]
        f = _describe(np.array([x for x, _, _, _ in found], float) - known[0], self.hz)
        values = [*f[:4], float(np.mean([k for _, k, _, _ in found])) - known[1], *f[4:], share]
        values = [None if v != v else float(v) for v in values]
        return [*values, None not in values]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RUN.split(", ")]
        run = dict(zip(names, self.run.get(), strict=True)) if self.run.exists() else None
        failed_before = run is not None and run["failed"] is not None
        parts = list(rows)
        batch = (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values(["version", "frame_id"], kind="stable")
        new: list[tuple] = []
        for version, frame, t, *told in batch[["version", "frame_id", "sim_time_s", "x", "k", "got", "c", "names"]].itertuples(index=False):
            if run is None:
                run = self._fresh(version, 0)
            elif version < run["version"]:
                run["fenced"] += 1
                continue
            elif version > run["version"] or (frame == 1 and run["last"]):
                run, new, failed_before = self._fresh(version, run["epoch"] + 1, run["fenced"]), [], False
            if run["failed"]:
                continue
            if frame != run["last"] + 1:
                run["failed"] = f"gap before frame {frame}"
            elif run["t"] is not None and t <= run["t"]:
                run["failed"] = f"time of frame {frame} does not grow"
            else:
                run["last"], run["t"] = int(frame), float(t)
                new.append(tuple([None if v is None or v != v else v for v in list(column)] for column in told))
        out = []
        if run["failed"]:
            self.frames.clear()
            run["kept"] = 0
            if not failed_before:
                out.append((key[0], run["epoch"], None, None, *[None] * 9, run["skipped"], run["fenced"], f"failed: {run['failed']}"))
        else:
            out = self._advance(key, run, new)
        self.run.update(tuple(run.values()))
        if self.idle_s is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at if isinstance(at, int) else at[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle_s * 1000))
        yield self._rows(out)

    def _advance(self, key: tuple, run: dict[str, Any], new: list[tuple]) -> list[tuple]:
        """Adds frames to the state; rows of the newest complete window if it is a new one."""
        start = self.first + (run["last"] - self.size - self.first) // self.hop * self.hop
        due = run["last"] >= self.first + self.size and (run["analysed"] is None or start > run["analysed"])
        completes = not run["framed"] and run["last"] >= self.first
        keep = self.size + self.hop
        full = run["framed"] and run["kept"] + len(new) > keep + self.hop
        if not (due or completes or full):
            if new:
                self.frames.appendList(new)
                run["kept"] += len(new)
            return []
        held = [*([tuple(f) for f in self.frames.get()] if run["kept"] else []), *new]
        if completes:
            for name, known in self._reference(held[: self.first]).items():
                self.known.updateValue((name,), known)
            run["framed"] = True
        out = []
        at = start - (run["last"] - len(held))
        if due and at >= 0:
            run["skipped"] += (start - (self.first - self.hop if run["analysed"] is None else run["analysed"])) // self.hop - 1
            for (name,), known in sorted(self.known.iterator(), key=lambda x: x[0][0]):
                out.append((key[0], run["epoch"], start, name, *self._window(name, known, held[at : at + self.size]), run["skipped"], run["fenced"], "running"))
            run["analysed"] = start
        if completes or full:
            held = held[-keep:]
            self.frames.put(held)
            run["kept"] = len(held)
        elif new:
            self.frames.appendList(new)
            run["kept"] += len(new)
        return out

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        run = dict(zip([c.split()[0] for c in RUN.split(", ")], self.run.get(), strict=True))
        said = run["failed"]
        run["failed"], run["kept"] = said or "idle", 0
        self.frames.clear()
        self.run.update(tuple(run.values()))
        yield self._rows([] if said else [(key[0], run["epoch"], None, None, *[None] * 9, run["skipped"], run["fenced"], "idle")])

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return _NOTHING if not out else pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype(object).where(lambda d: d.notna(), None)

    def close(self) -> None:
        pass


def frames_per_update(hz: float, refresh_hz: float) -> int:
    """Frames that make one update: what a source's rate limit for each trigger is set to."""
    return math.ceil(hz / refresh_hz)


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps streams' state where lists, maps and timers can be; the caller's stays as it is.

    Each partition of the state opens a store in every micro-batch, however few sessions it holds, so there are twice as
    many as cores at most.  A checkpoint keeps the number that it began with.
    """
    own = spark.newSession()
    own.conf.set(*PROVIDER)
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if spark.conf.get(k, None) is not None:
            own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.shuffle.partitions", str(min(int(own.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)))
    return own


def analyse(frames: DataFrame, initial: DataFrame | None = None, **shape: float) -> DataFrame:
    """The stream of newest-window features; frames is a streaming DataFrame of the frame schema, of a stateful() session.

    initial: rows of INITIAL, for sessions that go on behind a frame with references that are known.
    """
    timed = "ProcessingTime" if shape.get("idle_s") is not None else "None"
    begin = initial.groupBy("session_id") if initial is not None else None
    return samples(frames).groupBy("session_id").transformWithStateInPandas(Newest(**shape), OUT, "append", timed, initialState=begin)


def arrive(rows: DataFrame, path: str, checkpoint: str, into: str, **shape: float) -> None:
    """One arrival of frames: written to the stream's folder and analysed as one micro-batch from the checkpoint on.

    The query ends with the arrival and the next call goes on from its checkpoint, as a job that is started for each
    delivery does; results are appended exactly once.
    """
    from ..sources.tables import FRAME as SCHEMA

    rows.write.mode("append").parquet(path)
    source = stateful(rows.sparkSession).readStream.schema(SCHEMA).parquet(path)
    query = analyse(source, **shape).writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def recent(frames: DataFrame, capacity: int) -> DataFrame:
    """Batch view of a bounded buffer: the newest `capacity` frames of each session, with how many were overwritten."""
    top = frames.groupBy("session_id").agg(F.max("frame_id").alias("_top"))
    kept = frames.join(top, "session_id").filter(F.col("frame_id") > F.col("_top") - capacity)
    return kept.withColumn("overwritten", F.greatest(F.col("_top") - capacity, F.lit(0))).drop("_top")
