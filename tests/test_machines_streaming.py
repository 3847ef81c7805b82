"""Every machine as a stream gives the rows of its batch operator; gaps, timers, channels and the sample source."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import device, gates, tracking
from pulsegrid.params import BeatParams, MultiFrameParams, OnsetVectorParams, PredictorParams, QuantileParams, QueueParams
from pulsegrid.sources import channels, samples
from pulsegrid.streaming import stateful as S

SCHEMA = "stream_id long, frame_idx long, x double, t double, wall double, gates array<double>, bands array<double>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for s in (1, 2):
        for i in range(60):
            x = float(rng.gamma(2, 10))
            hit = [float(i % 5 == 0), float(i % 4 == 0), 0.0, float(x > 30), 0.0]
            out.append((s, i, x, i * 0.5 + x / 1000, i * 0.5 + x / 500, hit, [x, x * (i % 3), 1.0]))
    return out


def stream_of(spark, folder, parts, schema):
    (folder / "src").mkdir()
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"in{n}"))
        for p in (folder / f"in{n}").glob("*.parquet"):
            p.rename(folder / "src" / f"{n}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "src"))


def drained(stream, folder):
    got = []
    q = S.to_sinks(stream, lambda df, n: got.extend(tuple(r) for r in df.collect()), str(folder / "ck"))
    q.processAllAvailable()
    q.stop()
    return got


MULTI = MultiFrameParams(window_size=6, peak_threshold=1.0, trend_threshold=1.2, variance_threshold=1.2, refractory=2, warmup=8)
MACHINES = {
    "vector": (lambda s: S.onset_gate_vector_stream(s, OnsetVectorParams("hfc", threshold=0.5, refractory=2, warmup=4, smooth_window=2, odf_window=8)), lambda d: gates.onset_gate_vector(d, OnsetVectorParams("hfc", threshold=0.5, refractory=2, warmup=4, smooth_window=2, odf_window=8)).select("stream_id", "frame_idx", "band", "hit")),
    "multiframe": (lambda s: S.multiframe_gate_stream(s, MULTI), lambda d: gates.multiframe_gate(d, MULTI)),
    "quantile": (lambda s: S.quantile_gate_stream(s, QuantileParams(refractory=2, warmup=9)), lambda d: gates.quantile_gate(d, QuantileParams(refractory=2, warmup=9))),
    "textbook": (lambda s: S.quantile_gate_stream(s, QuantileParams(refractory=2, warmup=9, compat="textbook", q_hi=0.8, q_lo=0.4)), lambda d: gates.quantile_gate(d, QuantileParams(refractory=2, warmup=9, compat="textbook", q_hi=0.8, q_lo=0.4))),
    "kalman": (lambda s: S.beat_kalman_stream(s, BeatParams()), lambda d: tracking.beat_kalman(d)),
    "clock": (lambda s: S.clock_offset_stream(s), lambda d: tracking.clock_offset(d)),
    "predictor": (lambda s: S.predictor_stream(s, PredictorParams(sample_rate=10.0, hop_size=1, warmup_hits=3)), lambda d: tracking.instrument_predictor(d, PredictorParams(sample_rate=10.0, hop_size=1, warmup_hits=3))),
}


@pytest.mark.parametrize("name", MACHINES)
def test_stream_equals_batch(spark, rows, tmp_path, name):
    stream, batch = MACHINES[name]
    parts = [rows[:25] + rows[60:80], rows[30:50] + rows[80:90], rows[25:30] + rows[50:60] + rows[90:]]
    got = drained(stream(stream_of(spark, tmp_path, parts, SCHEMA)), tmp_path)
    want = [tuple(r) for r in batch(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) and sorted(map(str, got)) == sorted(map(str, want))


def test_textbook_quantiles_are_numpys():
    gate, x = gates.QuantileGate(QuantileParams(compat="textbook")), np.random.default_rng(1).normal(size=50)
    for v in x:
        gates.insort(gate.sorted, v)
    assert np.isclose(gate._quantile(0.98), np.quantile(x, 0.98)) and np.isclose(gate._quantile(0.8), np.quantile(x, 0.8))


def test_lost_frames_do_not_hold_a_stream(spark, rows, tmp_path):
    """Frame 10 never comes: with few rows held allowed, the frames behind it are given all the same."""
    some = [r for r in rows if r[0] == 1 and r[1] != 10]
    stream = stream_of(spark, tmp_path, [some[:20], some[20:]], SCHEMA).select("stream_id", "frame_idx", "t")
    got = drained(S.stateful(stream, lambda: tracking.BeatKalman(), S._schema(S._FRAME, phase=S._D, period=S._D, std=S._D), max_held=15), tmp_path)
    assert sorted(r[1] for r in got) == [i for i in range(60) if i != 10]


def test_bands_that_change_start_anew(spark):
    p = OnsetVectorParams("rms", threshold=0.5, refractory=1, warmup=2, smooth_window=1, odf_window=8)
    rng = np.random.default_rng(2)
    frames = [(1, i, [float(v) for v in rng.gamma(2, 5, 2 if i < 20 else 3)]) for i in range(40)]
    hits = lambda part: {(r["frame_idx"], r["band"]): r["hit"] for r in gates.onset_gate_vector(spark.createDataFrame(part, "stream_id long, frame_idx long, bands array<double>"), p).collect()}
    assert hits(frames) == {**hits(frames[:20]), **hits(frames[20:])}


def test_device_queue_stream_and_timers(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    base = int(t0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    at = lambda ms: base + ms * 1000
    schema = "stream_id long, arrival_us long, seq long, execute_time_us long, red boolean, green boolean, blue boolean, event_id int, ts timestamp_ntz"
    row = lambda stream, seq, ms, due: (stream, at(ms), seq, at(due), True, False, False, seq, t0 + dt.timedelta(milliseconds=ms))
    parts = [[row(1, 0, 0, 500), row(2, 0, 0, 100)], [row(1, 1, 1000, 1200)], [row(2, 9, 60_000, 60_000)], [row(3, 0, 120_000, 120_000)]]
    stream = stream_of(spark, tmp_path, parts, schema)
    got = drained(S.device_queue_stream(stream, QueueParams()), tmp_path)
    batch = spark.createDataFrame([r for p in parts for r in p], schema)
    want = [tuple(r) for r in device.device_queue(batch, QueueParams()).collect()]
    early = [r for r in want if r[1] <= at(60_000) and r[0] != 3]
    assert set(early) <= set(got) <= set(want) and len(got) == len(set(got))


def test_channel_round_trip(spark, rows, tmp_path):
    out = tracking.instrument_predictor(spark.createDataFrame(rows, SCHEMA), PredictorParams(sample_rate=10.0, hop_size=1, warmup_hits=3))
    gate = spark.createDataFrame([("gate.kick", 5, [1.0, 2.0])], "feature_name string, frame_count long, values array<double>")
    texts = channels.prediction_payloads(out).unionByName(channels.gate_payloads(gate)).unionByName(spark.createDataFrame([("gates", "{broken"), ("gates", None)], "topic string, payload string"))
    channels.publisher(str(tmp_path / "c"))(texts, 0)
    channels.publisher(str(tmp_path / "c"))(texts, 0)  # a repeated batch takes its own place
    first = json.loads(channels.prediction_payloads(out).orderBy("payload").first()["payload"])
    assert len(first["predictions"]) == 5
    messages = channels.message_stream(spark, str(tmp_path / "c"))
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert [r[0] for r in drained(channels.gate_stream(messages), tmp_path / "a")] == ["gate.kick"]
    assert len(drained(channels.prediction_stream(messages), tmp_path / "b")) == out.count()


def test_sample_source(spark, tmp_path):
    x = np.arange(1000, dtype="<f4")
    x.tofile(tmp_path / "a.f32")
    (x[:300] + 0.5).astype("<f4").tofile(tmp_path / "b.f32")
    samples.register(spark)
    load = lambda r: r.format("pulsegrid_samples").option("path", str(tmp_path / "*.f32")).option("chunk", 256).option("chunks_per_task", 2)
    name = {samples.stream_id(str(tmp_path / f)): i for i, f in enumerate(("a.f32", "b.f32"))}
    got = {(name[r["stream_id"]], r["chunk_idx"]): r["samples"] for r in load(spark.read).load().collect()}
    assert sorted(got) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)] and got[0, 3] == x[768:].tolist() and len(got[1, 1]) == 44
    (tmp_path / "w").mkdir()
    streamed = drained(load(spark.readStream).option("max_chunks_per_trigger", 2).load(), tmp_path / "w")
    assert sorted((name[r[0]], r[2]) for r in streamed) == [(0, 0), (0, 1), (0, 2), (1, 0)] and all(len(r[3]) == 256 for r in streamed)
    with pytest.raises(Exception, match="positive"):
        spark.read.format("pulsegrid_samples").option("path", "x").option("chunk", 0).load().collect()


def test_aggregates_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0, [1.0, 3.0])], "stream_id long, feature string, mean double, frames array<double>")
    channels.write_aggregates(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("feature", "mean", F.size("frames")).first()[0:3] == ("a", 2.0, 2)
