"""State features against plain loops, and their invariances."""

import copy
import math

import numpy as np
import pytest
from fieldloom.operators import quality, state8
from fieldloom.streaming import state8 as stream
from pyspark.sql import functions as F

SECONDS, NODES = 14, ("a", "b", "c")


def frame_rows(seconds=SECONDS, session="s"):
    """Frames in plain Python: three nodes, a wave and a step of temperature from 8 s on."""
    from datetime import datetime, timedelta, timezone

    epoch, out = datetime(2026, 1, 1, tzinfo=timezone.utc), []
    for k in range(seconds * 100):
        t = k / 100
        readings = []
        for n, name in enumerate(NODES):
            wave = (20 + n) * math.sin(2 * math.pi * (t - 8) + n / 3) + 0.2 * math.sin(20 * math.pi * t) if t >= 8 else 0.0
            readings.append({"sensor_id": name, "sequence_id": k + 1, "acquisition_time": epoch + timedelta(seconds=t), "arrival_time": epoch + timedelta(seconds=t), "measurement_mode": "vector", "value_T": None, "components_T": [(20000 + 100 * n + wave + (k * 7919 % 13) * 0.01) * 1e-9, 0.0, 4e-5], "saturation_mask": [False] * 3, "quality_flags": [], "valid": True, "observed_temperature_K": 293.0 + 2 * (t >= 8), "position_m": [0.0] * 3, "orientation_world_to_sensor_wxyz": [1.0, 0.0, 0.0, 0.0], "calibration_version": "v1"})
        out.append({"session_id": session, "configuration_version": 1, "frame_id": k + 1, "sim_time_s": t, "readings": readings})
    return out


def to_df(spark, rows):
    from fieldloom.sources.tables import FRAME

    return spark.createDataFrame(rows, FRAME)


def loop_features(rows, name, s):
    x = {n: [r["components_T"][0] * 1e9 for f in rows for r in f["readings"] if r["sensor_id"] == n] for n in NODES}
    a = {n: [v - sum(x[n][:800]) / 800 for v in x[n][s : s + 400]] for n in NODES}
    own = a[name]
    mean, middle = sum(own) / 400, sorted(own)
    middle = (middle[199] + middle[200]) / 2
    dev = sorted(abs(v - middle) for v in own)
    slope = sum((k - 199.5) * v for k, v in enumerate(own)) * 100 / sum((k - 199.5) ** 2 for k in range(400))
    flat = [v - mean - slope * (k - 199.5) / 100 for k, v in enumerate(own)]
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / 399) for k in range(400)]
    power = []
    for b in range(1, 81):
        c = sum(v * h * math.cos(2 * math.pi * b * k / 400) for k, (v, h) in enumerate(zip(flat, hann)))
        d = sum(v * h * math.sin(2 * math.pi * b * k / 400) for k, (v, h) in enumerate(zip(flat, hann)))
        power.append(2 * (c * c + d * d) / (100 * sum(h * h for h in hann)) * 0.25)
    ratio = 10 * math.log10(sum(power[:7]) / sum(power[7:]))
    rms = math.sqrt(sum((q - p) ** 2 for p, q in zip(own, own[1:])) / 399)
    peers = [a[n] for n in NODES if n != name]
    rest = [v - sum(p) / 2 for v, *p in zip(own, *peers)]
    return [mean, 1.4826 * (dev[199] + dev[200]) / 2, slope, ratio, 2.0, rms, np.corrcoef(own[:-1], own[1:])[0, 1], 1.0], [math.sqrt(sum(r * r for r in rest) / 400), np.mean([np.corrcoef(own, p)[0, 1] for p in peers])]


def test_features_equal_loops(spark):
    rows = frame_rows()
    df = to_df(spark, rows).cache()
    local = {(r.sensor_id, r.s): r for r in state8.features(df).collect()}
    network = {(r.sensor_id, r.s): r for r in state8.features(df, profile="network").collect()}
    assert local.keys() == {(n, s) for n in NODES for s in (800, 900, 1000)} == network.keys()
    for key in local:
        want, peers = loop_features(rows, *key)
        assert local[key].valid and network[key].valid and local[key].flags == []
        assert local[key]["values"] == pytest.approx(want, abs=1e-6)
        assert network[key]["values"][5:7] == pytest.approx(peers, abs=1e-6)
        assert network[key].peers == sorted(set(NODES) - {key[0]})
    newest = state8.features(df, latest=True).collect()
    assert {(r.sensor_id, r.s) for r in newest} == {(n, 1000) for n in NODES}
    assert all(r["values"] == pytest.approx(local[r.sensor_id, r.s]["values"], rel=1e-9) for r in newest)
    # Causal: a prefix of the frames gives the same windows.
    part = {(r.sensor_id, r.s): r["values"] for r in state8.features(to_df(spark, rows[:1300])).collect()}
    assert len(part) == 6 and all(v == pytest.approx(local[k]["values"], rel=1e-9) for k, v in part.items())


MUTATIONS = {
    "missing_frame": lambda f: f.pop(1250),
    "missing_reading": lambda f: f[1250]["readings"].pop(0),
    "clipped": lambda f: f[1250]["readings"][0].update(saturation_mask=None),
    "stuck": lambda f: f[1250]["readings"][0].update(quality_flags=["stuck"]),
    "clock_error": lambda f: f[1250]["readings"][0].update(quality_flags=["clock_error"]),
    "unsupported_quality_flag": lambda f: f[1250]["readings"][0].update(quality_flags=["odd"]),
    "missing_vector_components": lambda f: f[1250]["readings"][0].update(components_T=None),
    "reading_marked_invalid": lambda f: f[1250]["readings"][0].update(valid=False),
    "calibration_version_changed": lambda f: f[1250]["readings"][0].update(calibration_version="v2"),
    "duplicate_sensor_id": lambda f: f[1250]["readings"].append(copy.deepcopy(f[1250]["readings"][0])),
    "nonuniform_sampling": lambda f: f[1250].update(sim_time_s=12.501),
    "nonuniform_sequence": lambda f: f[1250]["readings"][0].update(sequence_id=7),
}


def test_bad_readings_abstain(spark):
    rows = []
    for name, change in MUTATIONS.items():
        own = frame_rows(session=name)
        change(own)
        rows += own
    out = {(r.session_id, r.sensor_id, r.s): r for r in state8.features(to_df(spark, rows)).collect()}
    for name in MUTATIONS:
        hit, before = out[name, "a", 1000], out[name, "a", 800]
        assert before.valid and not hit.valid and name in hit.flags
        assert hit["values"][:7] == [None] * 7 and hit["values"][7] is not None
    assert out["missing_reading", "b", 1000].valid and out["missing_reading", "a", 1000]["values"][7] == 399 / 400


def test_invalid_reference_and_constant_signal(spark):
    rows = frame_rows()
    rows[100]["readings"][1]["valid"] = False
    for f in rows:
        f["readings"][2]["components_T"] = [2e-5, 0.0, 0.0]
    df = to_df(spark, rows)
    ref = {r.sensor_id: r for r in state8.reference(df).collect()}
    assert ref["b"].north_ref is None and "reading_marked_invalid" in ref["b"].flags and ref["a"].valid
    out = {(r.sensor_id, r.s): r for r in state8.features(df).collect()}
    assert "reference_invalid" in out["b", 800].flags
    assert out["c", 800].flags == ["lag1_correlation_undefined"] and out["c", 800]["values"][6] is None
    peers = {(r.sensor_id, r.s): r for r in state8.features(df, profile="network").collect()}
    assert "insufficient_valid_peer_context" in peers["a", 800].flags


def test_first_frame_of_an_index_wins(spark):
    rows = frame_rows(1)
    again = copy.deepcopy(rows[5])
    again.update(frame_id=1000, sim_time_s=rows[5]["sim_time_s"] + 1e-4)
    found = {r.i: r for r in quality.index_frames(to_df(spark, [*rows, again])).collect()}
    assert len(found) == 100 and found[5].odd and found[5].frame_id == 6 and not found[6].odd
    assert quality.order_faults(to_df(spark, rows)).isEmpty()
    rows[7]["sim_time_s"] = 0.0
    assert [r.frame_id for r in quality.order_faults(to_df(spark, rows)).collect()] == [8]


def test_stream_equals_batch_and_fails_on_gaps(spark, tmp_path):
    rows = frame_rows()
    source = tmp_path / "in"
    source.mkdir()
    df = to_df(spark, rows).unionByName(to_df(spark, [r | {"session_id": "gap"} for r in rows if r["frame_id"] != 900]))
    for k in range(3):
        df.filter((F.col("frame_id") > k * 500) & (F.col("frame_id") <= k * 500 + 500)).coalesce(1).write.json(f"{tmp_path}/part{k}")
        for f in (tmp_path / f"part{k}").glob("*.json"):
            f.rename(source / f"{k}.json")
    from fieldloom.sources.tables import FRAME

    own = stream.stateful(spark)
    streaming = own.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).json(str(source))
    q = stream.analyse(streaming).writeStream.format("memory").queryName("newest").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    out = own.table("newest").collect()
    batch = {(r.sensor_id, r.s): r["values"] for r in state8.features(to_df(spark, rows)).collect()}
    mine = [r for r in out if r.session_id == "s"]
    assert {(r.sensor_id, r.start) for r in mine} == {(n, 1000) for n in NODES} and {r.skipped for r in mine} == {2}
    for r in mine:
        assert [r.f0, r.f1, r.f2, r.f3, r.f5, r.f6] == pytest.approx([v for k, v in enumerate(batch[r.sensor_id, 1000][:7]) if k != 4], abs=1e-9)
    assert any(r.status == "failed: gap before frame 901" for r in out if r.session_id == "gap")
    recent = stream.recent(df, 100)
    assert recent.filter("session_id = 's'").count() == 100 and recent.select("overwritten").first()[0] == 1300
