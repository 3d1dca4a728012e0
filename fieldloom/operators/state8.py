"""Eight features of causal windows against a session's own reference.

reference(): means of the first REFERENCE samples of every sensor, null unless
every sample is usable and the clock even.  features(): windows of SIZE samples
each HOP from the end of the reference on; a window whose samples aren't all
usable abstains: its features are null but for the received fraction.

Each sample goes to its windows by explode, so a window is one bounded group;
spectra of many windows at once are NumPy in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality
from .windows import slide

REFERENCE, SIZE, HOP = 800, 400, 100
LEAST_NODES = 3
LOW, MIDDLE, HIGH, FLOOR = 0.25, 2.0, 20.0, 1e-12
CORE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("f0", "f1", "f2", "f3", "f5", "f6")])


def reference(frames: DataFrame, n: int = REFERENCE, hz: float = quality.HZ) -> DataFrame:
    """(session_id, sensor_id, calibration, usable, north_ref, temperature_ref, valid, flags)."""
    indexed = quality.index_frames(frames, hz).filter(F.col("i") < n)
    framed = indexed.groupBy("session_id").agg(F.count("*").alias("n_frames"))
    s = quality.samples(quality.readings(indexed))
    per = s.groupBy("session_id", "sensor_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "sequence", "micros"))).alias("t"),
        F.array_distinct(F.flatten(F.collect_set("flags"))).alias("own"),
        F.collect_set("calibration").alias("calibrations"),
        F.sum(F.col("usable").cast("int")).alias("usable"),
        F.count("*").alias("n"),
        F.max("odd").alias("odd"),
        F.max("twice").alias("twice"),
        F.avg(F.when(F.col("usable"), F.col("x"))).alias("north"),
        F.avg(F.when(F.col("usable"), F.col("temperature"))).alias("warm"),
    )
    even = quality.even(F.col("t"), n, hz)
    tests = {"missing_reference_frame": F.col("n_frames") < n, "missing_reading": F.col("n") < F.col("n_frames"), "nonuniform_reference_sampling": F.col("odd"), "duplicate_sensor_id": F.col("twice"), "reference_calibration_not_stable": F.size("calibrations") != 1, "nonuniform_reference_sequence": ~even["sequence"], "nonuniform_reference_clock": ~even["clock"]}
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()]))
    judged = per.join(framed, "session_id").withColumn("flags", F.array_sort(F.array_distinct(F.concat("own", found))))
    valid = (F.col("usable") == n) & (F.size("flags") == 0)
    only = lambda c: F.when(valid, c)
    return judged.select("session_id", "sensor_id", only(F.get("calibrations", F.lit(0))).alias("calibration"), "usable", only(F.col("north")).alias("north_ref"), only(F.col("warm")).alias("temperature_ref"), valid.alias("valid"), "flags")


def windows(frames: DataFrame, ref: DataFrame, first: int = REFERENCE, size: int = SIZE, hop: int = HOP, hz: float = quality.HZ) -> DataFrame:
    """(session_id, sensor_id, s, origin_s, received, usable, flags, anomaly, warmer): one row per sensor and window.

    Windows are those that the session's frames reach the end of.
    """
    indexed = quality.index_frames(frames, hz)
    ends = indexed.groupBy("session_id").agg(F.max("i").alias("last"), F.first("origin_s").alias("origin_s"))
    starts = ends.filter(F.col("last") >= first + size - 1).select("session_id", "origin_s", F.explode(F.sequence(F.lit(first), F.col("last") - size + 1, F.lit(hop))).alias("s"))
    per_window = slide(indexed.select("session_id", "i"), size, hop, first).groupBy("session_id", "s").agg(F.count("*").alias("n_frames"))
    grid = starts.join(ref, "session_id").join(per_window, ["session_id", "s"], "left")

    known = quality.readings(indexed).join(ref.select("session_id", "sensor_id", F.col("calibration").alias("expected")), ["session_id", "sensor_id"])
    s = slide(quality.samples(known, F.col("expected")), size, hop, first)
    per = s.groupBy("session_id", "sensor_id", "s").agg(
        F.array_sort(F.collect_list(F.struct("i", "sequence", "micros", "x", "temperature", "usable"))).alias("t"),
        F.array_distinct(F.flatten(F.collect_set("flags"))).alias("own"),
        F.sum(F.col("received").cast("int")).alias("received"),
        F.max("odd").alias("odd"),
        F.max("twice").alias("twice"),
    )
    joined = grid.join(per, ["session_id", "sensor_id", "s"], "left").withColumn("t", F.coalesce("t", F.expr("cast(array() as array<struct<i:bigint,sequence:bigint,micros:bigint,x:double,temperature:double,usable:boolean>>)")))
    even = quality.even(F.col("t"), size, hz)
    usable = F.size(F.filter("t", lambda x: x["usable"]))
    tests = {"reference_invalid": ~F.col("valid"), "missing_frame": F.coalesce("n_frames", F.lit(0)) < size, "missing_reading": F.size("t") < F.coalesce("n_frames", F.lit(0)), "nonuniform_sampling": F.col("odd"), "duplicate_sensor_id": F.col("twice"), "nonuniform_sequence": ~even["sequence"], "nonuniform_clock": ~even["clock"]}
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()]))
    judged = joined.withColumn("flags", F.array_sort(F.array_distinct(F.concat(F.coalesce("own", F.array().cast("array<string>")), found))))
    whole = F.col("valid") & (usable == size) & (F.size("flags") == 0)
    anomaly = F.when(whole, F.transform("t", lambda x: x["x"] - F.col("north_ref")))
    warmer = F.when(whole, F.aggregate("t", F.lit(0.0), lambda a, x: a + x["temperature"]) / size - F.col("temperature_ref"))
    return judged.select("session_id", "sensor_id", "s", "origin_s", F.coalesce("received", F.lit(0)).alias("received"), usable.alias("usable"), "flags", anomaly.alias("anomaly"), warmer.alias("warmer"))


def _trend(x: np.ndarray, hz: float) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(x.shape[1]) / hz
    t = t - t.mean()
    centred = x - x.mean(axis=1, keepdims=True)
    slope = centred @ t / (t @ t)
    return slope, centred - slope[:, None] * t


def band_ratio_db(x: np.ndarray, hz: float = quality.HZ) -> np.ndarray:
    """Power in [LOW, MIDDLE) over that in [MIDDLE, HIGH] of detrended, Hann-windowed rows, in dB."""
    n = x.shape[1]
    hann = np.hanning(n)
    power = np.abs(np.fft.rfft(_trend(x, hz)[1] * hann, axis=1)) ** 2 / (hz * (hann @ hann))
    power[:, 1:-1] *= 2
    f = np.fft.rfftfreq(n, 1 / hz)
    low, high = (power[:, m].sum(axis=1) * hz / n for m in ((f >= LOW) & (f < MIDDLE), (f >= MIDDLE) & (f <= HIGH)))
    return 10 * np.log10(np.maximum(low, FLOOR) / np.maximum(high, FLOOR))


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; NaN where undefined."""
    a, b = a - a.mean(axis=-1, keepdims=True), b - b.mean(axis=-1, keepdims=True)
    bottom = np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(bottom > np.finfo(float).eps, np.clip((a * b).sum(axis=-1) / bottom, -1, 1), np.nan)


def _core(hz: float):
    @F.pandas_udf(CORE)
    def core(anomalies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in anomalies:
            out = np.full((len(column), 6), np.nan)
            have = column.notna().to_numpy()
            if have.any():
                x = np.stack(column[have].to_numpy())
                middle = np.median(x, axis=1, keepdims=True)
                spread = 1.4826 * np.median(np.abs(x - middle), axis=1)
                step = np.diff(x, axis=1)
                out[have] = np.stack([x.mean(axis=1), spread, _trend(x, hz)[0], band_ratio_db(x, hz), np.sqrt((step * step).mean(axis=1)), correlation(x[:, :-1], x[:, 1:])], axis=1)
            frame = pd.DataFrame(out, columns=CORE.names)
            yield frame.astype(object).where(frame.notna(), None)

    return core


PEER = T.StructType([T.StructField("f5", T.DoubleType()), T.StructField("f6", T.DoubleType())])


@F.pandas_udf(PEER)
def _peers(focal: pd.Series, peers: pd.Series) -> pd.DataFrame:
    rows = []
    for x, p in zip(focal, peers, strict=True):
        if x is None or p is None or len(p) < LEAST_NODES - 1:
            rows.append((None, None))
            continue
        x, p = np.asarray(x), np.stack(p)
        rest = x - np.median(p, axis=0)
        r = correlation(x[None, :], p)
        rows.append((float(np.sqrt((rest * rest).mean())), None if np.isnan(r).any() else float(r.mean())))
    return pd.DataFrame(rows, columns=PEER.names, dtype=object)


def features(frames: DataFrame, ref: DataFrame | None = None, profile: str = "local", latest: bool = False, **shape: float) -> DataFrame:
    """(session_id, sensor_id, s, window_id, start_s, values array<double>(8), valid, flags, peers, received, usable)."""
    hz, size = shape.get("hz", quality.HZ), shape.get("size", SIZE)
    ref = reference(frames, shape.get("first", REFERENCE), hz) if ref is None else ref
    w = windows(frames, ref, **shape)
    if latest:
        w = w.join(w.groupBy("session_id").agg(F.max("s").alias("s")), ["session_id", "s"])
    w = w.withColumn("c", _core(hz)(F.col("anomaly")))
    no_peers = F.array().cast("array<string>")
    if profile == "network":
        # A session has few sensors, so a window's sensors fit one row.
        all_ = w.groupBy("session_id", "s").agg(F.array_sort(F.collect_list(F.struct("sensor_id", "anomaly"))).alias("nodes"))
        w = w.join(all_, ["session_id", "s"]).withColumn("peers", F.filter("nodes", lambda n: (n["sensor_id"] != F.col("sensor_id")) & n["anomaly"].isNotNull()))
        w = w.withColumn("p", _peers(F.col("anomaly"), F.col("peers.anomaly")))
        f5, f6, names = F.col("p.f5"), F.col("p.f6"), F.when(F.col("anomaly").isNotNull() & (F.size("nodes") >= LEAST_NODES), F.col("peers.sensor_id")).otherwise(no_peers)
        few = F.size("nodes") < LEAST_NODES
        lacking = ~few & F.col("anomaly").isNotNull() & (F.size("peers") < LEAST_NODES - 1)
        extra = {"insufficient_network_context": few, "peer_context_invalid": lacking, "insufficient_valid_peer_context": lacking, "peer_correlation_undefined": F.col("p.f5").isNotNull() & F.col("p.f6").isNull()}
    else:
        f5, f6, names = F.col("c.f5"), F.col("c.f6"), no_peers
        extra = {"lag1_correlation_undefined": F.col("anomaly").isNotNull() & F.col("c.f6").isNull()}
    values = F.array("c.f0", "c.f1", "c.f2", "c.f3", "warmer", f5, f6, F.col("received") / float(size))
    added = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in extra.items()]))
    valid = F.forall(F.col("values"), lambda v: v.isNotNull())
    out = w.withColumn("values", values).withColumn("valid", valid).withColumn("names", names)
    return out.select(
        "session_id",
        "sensor_id",
        "s",
        F.concat_ws(":", "session_id", F.lit(profile), "sensor_id", F.col("s").cast("string"), (F.col("s") + size).cast("string")).alias("window_id"),
        (F.col("origin_s") + F.col("s") / hz).alias("start_s"),
        "values",
        "valid",
        F.when(F.col("valid"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_union("flags", added))).alias("flags"),
        F.col("names").alias("peers"),
        "received",
        "usable",
    )
