"""Hand-checked inputs and properties of the operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions import scalars as S
from pulsegrid.operators import aggregates, device, gates, lighting, registry, tracking
from pulsegrid.operators.scan import run_key
from pulsegrid.params import BufferParams, LightingParams, MultiFrameParams, OnsetParams, PredictorParams, QuantileParams, QueueParams
from pulsegrid.sources import messages
from pulsegrid.sources.tables import cut_frames, gate_frames


def frames(spark, values, stream=1):
    return spark.createDataFrame([(stream, i, float(x)) for i, x in enumerate(values)], "stream_id long, frame_idx long, x double")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("method, smooth, want", [("hfc", 2, [0, 0, 10, 0, 12]), ("hfc", 1, [0] * 5), ("flux", 1, [0] * 5), ("complex", 2, [0, 7, 3, 1, 11])])
def test_onset_strength(method, smooth, want):
    gate = gates.OnsetGate(OnsetParams(method, warmup=1, smooth_window=smooth))
    assert gate.process(pd.DataFrame({"x": [5, 7, 10, 4, 12]}))["odf"].tolist() == want


def test_textbook_strength_differences_inputs():
    gate = gates.OnsetGate(OnsetParams("complex", warmup=1, smooth_window=2, compat="textbook"))
    assert gate.process(pd.DataFrame({"x": [5, 7, 10, 4, 12]}))["odf"].tolist() == [0, 2, 3, 0, 8]


def test_refractory_fixture():
    candidate = np.isin(np.arange(12), [1, 2, 4, 5, 9])
    assert np.flatnonzero(gates.Refractory(4).accept(candidate)).tolist() == [1, 5, 9]


@pytest.mark.parametrize("make", [lambda: gates.OnsetGate(OnsetParams("hfc", threshold=0.5, refractory=3, warmup=4, smooth_window=2, odf_window=16)), lambda: gates.OnsetBandGate(), lambda: gates.QuantileGate(QuantileParams(warmup=10)), lambda: gates.QuantileGate(QuantileParams(warmup=10, compat="textbook"))])
def test_machines_ignore_batch_borders(make):
    x = np.random.default_rng(3).gamma(2, 10, 300)
    whole = make().process(pd.DataFrame({"x": x}))["hit"]
    machine, parts, at = make(), [], 0
    for n in (1, 2, 5, 17, 40, 100, 135):
        parts.append(machine.process(pd.DataFrame({"x": x[at : at + n]}))["hit"])
        at += n
    assert np.concatenate(parts).tolist() == whole.tolist()
    assert set(whole.tolist()) <= {0, 1}


def test_quantile_limits():
    gate = gates.QuantileGate()
    gate.process(pd.DataFrame({"x": [3, 9, 4, 8, 1, 7, 2]}))
    assert gate.limits() == (4, 4)


def test_hits_keep_their_distance(spark):
    x = np.random.default_rng(5).gamma(2, 10, 200)
    rows = gates.multiframe_gate(frames(spark, x), MultiFrameParams(6, 1.0, 1.1, 1.1, 7, 8, "peak")).where("hit = 1").orderBy("frame_idx").toPandas()
    assert (rows["frame_idx"].diff().dropna() >= 7).all() and len(rows)


def test_unknown_mode_never_fires(spark):
    assert gates.multiframe_gate(frames(spark, range(50)), MultiFrameParams(detection_mode="other")).where("hit = 1").count() == 0


def test_params_are_checked():
    for bad in (lambda: OnsetParams("fft"), lambda: OnsetParams(smooth_window=0), lambda: QuantileParams(q_hi=2), lambda: BufferParams(threshold_mode="near"), lambda: PredictorParams(min_bpm=0)):
        with pytest.raises(ValueError):
            bad()


def test_vectors(spark):
    v = F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))
    empty = F.array().cast("array<double>")
    row = one(spark, A.vector_index(v, -2), A.vector_index(v, 1), A.vector_index(v, 9), A.sum_range(v, 1, 2), A.sum_range(v, 2, 99), A.sum_range(v, 3, 1), A.sum_range(empty, 0, 5), F.size(A.instrument_sum(empty)), A.median_of(v), A.mad_of(v), A.median_of(empty))
    assert list(row) == [1, 2, 0, 5, 7, 0, 0, 0, 2.5, 1.0, None]


def test_masks():
    m = {k: np.array(v) for k, v in A.masks().items()}
    assert np.flatnonzero(m["kick"]).tolist() == [1] and m["kick"][1] == pytest.approx(1)
    assert [int((w > 0).sum()) for w in m.values()] == [1, 28, 33, 25, 27]
    assert all(w.sum() == pytest.approx(1) for w in m.values())
    assert A.mel_centres(64, 22050)[:3] == pytest.approx([19.30, 59.51, 101.97], abs=0.01)


def test_scalars(spark):
    t = F.lit(1.25)
    sec, us = S.unix_split(F.lit(100), F.lit(900000), t)
    row = one(spark, S.event_id(F.lit("kick"), F.lit(1.234)), S.event_id(F.lit("kick"), F.lit(1.236)), sec, us, S.wrap_unit(F.lit(-0.25)), S.wrap_half(F.lit(0.75)), S.instrument_index(F.lit("CLAP")), S.instrument_index(F.lit("x"), 0), S.feature_index(F.lit("gate.ohc")), S.json_field(F.lit('{"a": "z"}'), "a", "int", 4), S.query_flag(F.lit("/set?r=1&g=0"), "r"), F.transform(S.beat_forecast(F.lit(1.0), F.lit(1.0), F.lit(0.5), 4), lambda x: x))
    assert list(row) == ["kick_1.23", "kick_1.24", 102, 150000, 0.75, -0.25, 2, 0, 4, 4, 1, [1.5, 2.0, 2.5, 3.0]]


def test_negative_unix_split(spark):
    sec, us = S.unix_split(F.lit(100), F.lit(100), F.lit(-0.5))
    assert list(one(spark, sec, us)) == [99, 500100]


def gate_rows(times, n, dt=0.1):
    hits = {round(t / dt) for t in times}
    return pd.DataFrame({"stream_id": 1, "frame_idx": range(n), "gates": [[1.0 if i in hits else 0.0, 0, 0, 0, 0] for i in range(n)]})


def test_regular_train_warms_up_on_the_eighth_hit():
    p = tracking.InstrumentPredictor(PredictorParams(sample_rate=40960.0, hop_size=4096))
    out = p.process(gate_rows([0.5 * k for k in range(1, 12)], 60))
    kick = [(r.timestamp_sec, r.predictions[0]) for r in out.itertuples()]
    first = next(t for t, k in kick if k["warmup_complete"])
    assert first == pytest.approx(4.0) and kick[-1][1]["period_sec"] == pytest.approx(0.5, abs=0.01)
    for _, k in kick:
        assert 0 <= k["phase"] < 1 and 0.3 <= k["period_sec"] <= 1.0
        for h in k["hits"]:
            assert h["ci_low_sec"] <= h["t_pred_sec"] <= h["ci_high_sec"] and 0.3 <= h["confidence"] <= 1
    assert all(len(r.predictions) == 5 for r in out.itertuples())


def test_short_gates_do_not_count():
    p = tracking.InstrumentPredictor(PredictorParams())
    rows = gate_rows([0.0], 2)
    rows.at[0, "gates"] = [1.0]
    p.process(rows)
    assert p.frame == 1


def test_beat_filter_starts_at_the_first_beat():
    k = tracking.BeatKalman()
    out = k.process(pd.DataFrame({"t": [1.0, 1.5, 2.0, 2.5]}))
    assert out["phase"][0] == 1.0 and out["period"][0] == 0.5 and out["period"][-1] == pytest.approx(0.5, abs=1e-6)


def test_led_fixture(spark):
    e = spark.createDataFrame([(1, 0, 0, True, False, False, 1), (1, 100_000, 1, False, True, False, 2)], "stream_id long, execute_time_us long, seq long, red boolean, green boolean, blue boolean, event_id int")
    rows = [(r.from_us, r.to_us, r.red, r.green) for r in device.led_timeline(e).orderBy("from_us").collect()]
    assert rows == [(0, 100_000, True, False), (100_000, 150_000, False, True), (150_000, 250_000, False, False), (250_000, None, False, False)]


def test_queue_rejects_when_full_and_runs_late_events_at_once():
    q = device.DeviceQueue(QueueParams(capacity=2))
    rows = pd.DataFrame([(1, 0, 1000, True, False, False, 1), (1, 1, 500, False, True, False, 300), (1, 2, 700, False, False, True, 3), (1, 600, 100, True, False, False, 4)], columns=["stream_id", "arrival_us", "execute_time_us", "red", "green", "blue", "event_id"])
    out = pd.concat([q.process(rows), q.finish()])
    kinds = list(zip(out["kind"], out["event_id"], out["at_us"]))
    assert ("rejected", 3, 2) in kinds and ("on", 44, 500) in kinds and ("on", 4, 600) in kinds
    assert ("off", 44, 150_500) not in kinds  # full when the flash began


def test_buffering_fixture(spark):
    out = aggregates.buffered_messages(frames(spark, [0, 0.5, 0.9, 0.1, 1]), "gate.kick", BufferParams(2, 0.5, "above")).collect()
    assert [(r["values"], r["frame_count"]) for r in out] == [([0.5, 0.9], 3)]


def test_trajectory_fixture(spark):
    rows = aggregates.trajectory(spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0)], "move_id long, x0 double, x1 double, t0 double, t1 double")).orderBy("step").collect()
    assert len(rows) == 59 and rows[-1]["position"] == pytest.approx(1) and rows[-1]["time"] == pytest.approx(1)


def test_interval_filter(spark):
    t = [0.0, 0.2, 0.5, 4.5, 8.6]
    hits = spark.createDataFrame([(1, "kick", i, x) for i, x in enumerate(t)], "stream_id long, instrument string, frame_idx long, t double")
    last = tracking.hit_intervals(hits).orderBy("frame_idx").collect()[-1]
    assert last["n_valid"] == 2 and last["period_median"] == pytest.approx(2.15)


def test_only_kicks_are_sent_but_all_block(spark):
    rows = [(1, 0, 0.0, "kick", 1, 0.5, 0.4, 0.6, 0.9), (1, 1, 0.1, "kick", 1, 0.502, 0.4, 0.6, 0.9), (1, 1, 0.1, "snare", 1, 0.5, 0.4, 0.6, 0.9), (1, 2, 0.2, "kick", 1, 0.21, 0.4, 0.6, 0.9), (1, 2, 0.2, "kick", 2, 9.0, 0.4, 0.6, 0.9)]
    hits = spark.createDataFrame(rows, "stream_id long, frame_idx long, now double, instrument string, hit_index int, t_pred_sec double, ci_low_sec double, ci_high_sec double, confidence double")
    sent = lighting.commands(hits, LightingParams()).collect()
    assert [(r["event_id"], r["frame_idx"], r["r"]) for r in sent] == [("kick_0.50", 0, 1)]


def test_log_round_trip(spark, tmp_path):
    hits = spark.createDataFrame([(1, 5, "kick", 1.0), (1, 6, "snare", 0.2)], "stream_id long, frame_idx long, instrument string, value double")
    log = messages.hit_log(hits, 256, 44100.0)
    messages.write_log(log, str(tmp_path / "log"))
    back = messages.read_log(spark, str(tmp_path / "log/*")).collect()
    assert [(r["frame"], r["type"], r["instrument"]) for r in back] == [(5, "hit", "kick")]


def test_short_input_gives_no_frame(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "stream_id long, samples array<double>")
    assert cut_frames(df, 4, 2).count() == 0


def test_registry(spark):
    out = frames(spark, range(30)).transform(registry.create("HitGateOnset", threshold=1.0, warmup=2))
    assert out.count() == 30
    for bad in (("Nothing", {}), ("HitGateOnset", {"colour": 1})):
        with pytest.raises(ValueError):
            registry.create(bad[0], **bad[1])


def test_empty_stream(spark):
    assert gates.onset_gate(frames(spark, [])).count() == 0
    assert tracking.instrument_predictor(spark.createDataFrame([], "stream_id long, frame_idx long, gates array<double>")).count() == 0


def test_predictor_over_table(spark, sf):
    out = tracking.instrument_predictor(gate_frames(spark, sf), PredictorParams(sample_rate=40960.0, hop_size=4096))
    assert out.count() == 1000 and run_key is not None and math.isfinite(out.agg(F.max("timestamp_sec")).first()[0])


def test_spectral_peak(spark, sf):
    from pulsegrid.plans.queries import QUERIES

    rows = QUERIES["spectral_peak"](spark, sf).collect()
    assert len(rows) == 13 and {r["peak_bin"] for r in rows} == {10} and {r["n_mfcc"] for r in rows} == {13}


def test_inverse_covariance(spark):
    v = np.random.default_rng(1).normal(size=(50, 3))
    df = spark.createDataFrame([(1, i, [float(x) for x in row]) for i, row in enumerate(v)], "stream_id long, frame_idx long, bands array<double>")
    out = aggregates.inverse_covariance(df).collect()
    inv = np.zeros((3, 3))
    for r in out:
        inv[r["i"], r["j"]] = r["icov"]
    assert np.allclose(inv @ np.cov(v.T, bias=True), np.eye(3))


def test_inverse_covariance_of_whole_embeddings(spark, sf):
    """All 64 x 64 entries of each stream, of singular matrices as well, against numpy."""
    from pulsegrid.plans.queries import QUERIES

    streams = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        streams.setdefault(r["label"], []).append(r["embedding"])
    got = {s: np.full((64, 64), np.nan) for s in streams}
    for r in QUERIES["inverse_covariance"](spark, sf).collect():
        got[r["stream_id"]][r["i"], r["j"]] = r["icov"]
    for s, rows in streams.items():
        want = np.linalg.pinv(np.cov(np.array(rows, float).T, bias=True), rcond=1e-10, hermitian=True)
        assert np.allclose(got[s], want, rtol=1e-5, atol=2e-6)
