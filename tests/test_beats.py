import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import beats as B
from pulsegrid.operators import registry
from pulsegrid.sources.messages import beat_line
from pulsegrid.sources.tables import cut_frames


def test_beats_only_and_intervals(spark):
    rows = [(1, i, t, 1) for i, t in enumerate([0.0, 0.1, 0.6, 1.1, 3.0, *[3.5 + k * 0.5 for k in range(9)]])] + [(1, 99, 9.9, 0)]
    df = B.beats_only(spark.createDataFrame(rows, "stream_id long, frame_idx long, t double, flag int"))
    out = {r["frame_idx"]: r for r in B.intervals(df).collect()}
    assert len(out) == 14 and [out[i]["beat_no"] for i in range(3)] == [1, 2, 3]
    assert [out[i]["ibi_valid"] for i in range(5)] == [False, False, True, True, False]
    assert out[3]["recent_ibis"] == [0.5, 0.5] == out[4]["recent_ibis"] and out[0]["recent_ibis"] == [] and len(out[13]["recent_ibis"]) == 8
    assert B.intervals(df.limit(0)).count() == 0


def test_delayed_shows(spark):
    df = spark.createDataFrame([(1, 2.0, [1.9, 2.5, 3.0]), (2, 0.0, []), (3, 0.0, None), (4, 1.0, [1.0, 1.5])], "stream_id long, now double, predicted array<double>")
    assert {(r["stream_id"], r["index"], r["show_at"], r["delay"]) for r in B.delayed_shows(df).collect()} == {(1, 1, 2.5, 0.5), (4, 1, 1.5, 0.5)}


def test_queue_policies(spark):
    df = spark.createDataFrame([(1, 0, i, f"v{i}") for i in range(5)] + [(2, 0, 0, "w")], "k long, trigger long, at long, v string")
    kept = lambda d: sorted((r["k"], r["v"]) for r in d.collect())
    assert kept(B.bounded(df, ["k"], "at", 2)) == [(1, "v0"), (1, "v1"), (2, "w")]
    assert kept(B.bounded(df, ["k"], "at", 2, "oldest")) == [(1, "v3"), (1, "v4"), (2, "w")]
    assert kept(B.keep_latest(df, ["k"], "trigger", "at")) == [(1, "v4"), (2, "w")]
    with pytest.raises(ValueError):
        B.bounded(df, ["k"], "at", 0)


def test_payloads(spark):
    batch = json.loads(B.batch_payload(B.colour_pattern(spark, 20.5), F.lit(7)).first()["payload"])
    assert len(batch["events"]) == 7 and batch["batch_id"] == 7 and batch["events"][1] == {"unix_time": 21, "microseconds": 0, "r": 0, "g": 1, "b": 0, "event_id": 4001}
    assert json.loads(spark.range(1).select(B.time_sync_payload(F.lit(5), F.lit(6))).first()[0]) == {"unix_time": 5, "microseconds": 6, "sync_source": "host"}
    beat = [tuple(r) for r in B.beat_pattern(spark, 12.0).orderBy("event_id").collect()]
    assert beat[:2] == [(3000, 12, 0, 1, 0, 0), (3001, 12, 500_000, 0, 1, 0)] and len(beat) == 8
    sync = spark.createDataFrame([("a", 1, 10, 0), ("a", 2, 20, 5), ("b", 1, 7, 7)], "device_id string, received_us long, unix_time long, microseconds long")
    assert {tuple(r) for r in B.last_sync(sync).collect()} == {("a", 2, 20, 5), ("b", 1, 7, 7)}


def test_dedup_key_is_half_even(spark):
    rows = [(1, 0.125, 1, 5), (1, 0.121, 1, 3), (1, 0.135, 1, 4), (1, 0.125, 2, 9)]
    df = spark.createDataFrame(rows, "stream_id long, t double, event_type int, frame_idx long")
    assert {tuple(r) for r in B.first_of_each_beat(df).collect()} == {(1, 0.12, 1, 3), (1, 0.14, 1, 4), (1, 0.12, 2, 9)}


def test_log_lines(spark):
    df = spark.createDataFrame([(1, 1.5, [0.25, -0.1]), (2, 2.0, [])], "k int, t double, p array<double>")
    lines = {(r["k"], f): r[f] for r in df.select("k", *[beat_line(F.col("t"), F.col("p"), F.lit(0.0125), f).alias(f) for f in ("detailed", "simple", "csv")]).collect() for f in ("detailed", "simple", "csv")}
    assert lines[1, "detailed"] == "BEAT EVENT | Time: 1.500s | Next4: +0.250s, -0.100s (±12ms)" and lines[2, "detailed"].endswith("Next4: n/a (±12ms)")
    assert lines[1, "simple"] == "BEAT at 1.500s" and lines[1, "csv"] == "1.500,12.5,0.250,-0.100" and lines[2, "csv"] == "2.000,12.5,,,"


def test_frames_with_padding_and_silence(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0]), (2, []), (3, [0.0])], "stream_id long, samples array<double>")
    got = lambda **kw: {(r["stream_id"], r["frame_idx"]): r["frame"] for r in cut_frames(df, 3, 2, **kw).collect()}
    assert got() == {(1, 0): [1.0, 2.0, 3.0], (1, 1): [3.0, 0.0, 0.0], (1, 2): [0.0, 0.0, 0.0]}
    assert set(got(silent="drop")) == {(1, 0), (1, 1)}
    assert got(pad=True)[1, 3] == [0.0, 0.0, 0.0] and got(pad=True)[3, 0] == [0.0, 0.0, 0.0] and (2, 0) not in got(pad=True)
    with pytest.raises(ValueError):
        cut_frames(df, 3, 2, silent="noise")


def test_registry_knows_every_operator(spark):
    frames = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0])], "stream_id long, frame_idx long, bands array<double>")
    assert frames.transform(registry.create("SumRange", low=1, high=9)).first()["sum"] == 5.0
    assert frames.transform(registry.create("VectorIndex", index=2)).first()["value"] == 3.0
    cut = spark.createDataFrame([(1, [0.0, 1.0, 0.5, 2.0])], "stream_id long, samples array<double>").transform(registry.pipeline(registry.create("FrameCutter", frame_size=4, hop_size=4), registry.create("Windowing", frame_size=4), registry.create("Spectrum")))
    assert len(cut.first()["spectrum"]) == 3
    for name in registry.REGISTRY:
        assert callable(registry.create(name))
    silent = spark.createDataFrame([(1, 0, [0.0] * 3), (1, 1, [0.0] * 5)], "stream_id long, chunk_idx long, samples array<double>").transform(registry.create("FrameCutter", frame_size=4, hop_size=4, silent_frames="noise"))
    assert sorted(r["frame_idx"] for r in silent.collect()) == [0, 1] and all(any(r["frame"]) for r in silent.collect())
    for bad in ({"frame_size": 0}, {"silent_frames": "loud"}):
        with pytest.raises(ValueError):
            registry.create("FrameCutter", **bad)


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(S.is_gate(F.lit("gate.kick")), S.is_gate(F.lit("a.gate")), S.is_gate(F.lit("a.gate"), anywhere=True)).first()[0:3] == (True, False, True)
    assert tuple(one.select(S.place(F.lit(1), F.lit(2), 1200, 700, "vertical").alias("p")).first()["p"]) == (400, 314)
