"""Tempo and phase tracking: instrument predictor, beat Kalman filter, clock offset."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import mad_of, median_of
from ..params import INSTRUMENTS, BeatParams, PredictorParams
from .scan import ordered_scan

MAD_SCALE = 1.4826
#: Rows whose messages are in Python at a time.
ROWS = 1024


def _median(values: list[float]) -> float:
    s, n = sorted(values), len(values)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


class Tracker:
    """Period and phase of one instrument with their covariance."""

    def __init__(self, p: PredictorParams):
        self.p, self.low, self.high = p, 60.0 / p.max_bpm, 60.0 / p.min_bpm
        self.dt = p.hop_size / p.sample_rate
        self.warm, self.times, self.seen, self.last = False, [], 0, -1.0
        self.median, self.mad = 0.5, 0.0
        self.period, self.phase = 0.5, 0.0
        self.p00, self.p01, self.p11 = 0.01, 0.0, 0.01
        self.confidence = 0.0

    def predict(self) -> None:
        if not self.warm:
            return
        self.p00 += self.p.q_period * self.dt
        if self.period > 1e-6:
            turn = self.phase + self.dt / self.period
            self.phase = turn - math.floor(turn)
            slope = -self.dt / self.period**2
            self.p11 += self.p.q_phase * self.dt + slope * slope * self.p00
            self.p01 += slope * self.p00

    def update(self, now: float) -> None:
        self.times = (self.times + [now])[-20:]
        self.last, self.seen = now, self.seen + 1
        gaps = [b - a for a, b in zip(self.times, self.times[1:]) if self.low <= b - a <= 4 * self.high]
        if len(gaps) >= 2:
            self.median = _median(gaps)
            self.mad = MAD_SCALE * _median([abs(g - self.median) for g in gaps])
        if not self.warm and len(self.times) >= 2 and self.seen >= self.p.warmup_hits and len(gaps) >= self.p.warmup_hits - 1:
            self.warm, self.period, self.phase = True, self.median, 0.0
            self.p00, self.p11 = self.mad**2, 0.01
        if not self.warm or len(self.times) < 2:
            return
        off = (self.phase + 0.5) - math.floor(self.phase + 0.5) - 0.5
        spread = self.p11 + self.p.r_base * (1 + (self.mad / self.period if self.period > 1e-6 else 0.0))
        if spread >= 1e-9:
            k0, k1 = self.p01 / spread, self.p11 / spread
            self.period -= k0 * off
            turn = self.phase - k1 * off
            self.phase = turn - math.floor(turn)
            self.p00 = max(1e-6, self.p00 - k0 * spread * k0)
            self.p01 = self.p01 - k0 * spread * k1
            self.p11 = max(1e-6, self.p11 - k1 * spread * k1)
            if abs(off) > 0.1:
                self.period += -off * self.period * 0.1
        self.period = min(self.high, max(self.low, self.period))

    def belief(self, now: float) -> float:
        steady = min(1.0, max(0.0, 1 - self.mad / self.period)) if self.mad > 0 and self.period > 1e-6 else 0.0
        locked = min(1.0, max(0.0, 1 - 10 * math.sqrt(max(0.0, self.p11))))
        fresh = math.exp(-(now - self.last) / (self.p.decay * self.period)) if self.last > 0 and self.period > 1e-6 else 1.0
        self.confidence = min(1.0, max(0.0, 0.4 * locked + 0.3 * steady + 0.3 * fresh))
        return self.confidence

    def tempo(self) -> float:
        return 60.0 / self.period if self.period > 1e-6 else 0.0

    def sigma(self) -> float:
        s = math.hypot(self.phase * math.sqrt(max(0.0, self.p00)), self.period * math.sqrt(max(0.0, self.p11)))
        if self.mad > 0:
            s = math.sqrt(s * s + 0.25 * self.mad**2)
        return max(0.001, s)

    def forecast(self, now: float) -> list[tuple]:
        hits: list[tuple] = []
        if not self.warm or self.period < 1e-6:
            return hits
        t, index, end = now + (1 - self.phase) * self.period, 1, now + self.p.horizon_seconds
        if self.p.max_predictions < 1 or not t <= end:
            return hits
        belief = self.belief(now)  # one for all hits of a message, like their spread
        s = 1.96 * self.sigma()
        while index <= self.p.max_predictions and t <= end:
            if belief >= self.p.confidence_min:
                hits.append((t, t - s, t + s, belief, index))
            t, index = t + self.period, index + 1
        return hits


HIT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("t_pred_sec", "ci_low_sec", "ci_high_sec", "confidence")] + [T.StructField("hit_index", T.IntegerType())])
PREDICTION = T.StructType([T.StructField("instrument", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("tempo_bpm", "period_sec", "phase", "confidence_global")], T.StructField("warmup_complete", T.BooleanType()), T.StructField("hits", T.ArrayType(HIT))])
OUTPUT = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("frame_idx", T.LongType()), T.StructField("timestamp_sec", T.DoubleType()), T.StructField("predictions", T.ArrayType(PREDICTION))])


class InstrumentPredictor:
    """Five trackers and the emission rule: on any hit, or ``periodic_interval`` after the last emission.

    Frames with fewer than five gates are skipped and don't count. Frames that emit nothing give no row.
    """

    def __init__(self, params: PredictorParams = PredictorParams()):
        self.p, self.frame, self.last_emit = params, 0, None
        self.trackers = [Tracker(params) for _ in INSTRUMENTS]

    def step(self, gates) -> tuple[float, list[list[tuple]]] | None:
        """Time and each tracker's forecast if a frame of gates makes a message."""
        now, any_hit = self.frame * self.trackers[0].dt, False
        self.frame += 1
        for tracker, gate in zip(self.trackers, gates):
            tracker.predict()
            if gate >= 0.5:
                tracker.update(now)
                any_hit = True
        if not any_hit and now - (self.last_emit or 0.0) < self.p.periodic_interval:
            return None
        self.last_emit = now
        return now, [t.forecast(now) for t in self.trackers]

    def process(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for stream, frame, gates in zip(rows["stream_id"], rows["frame_idx"], rows["gates"]):
            made = None if gates is None or len(gates) < len(INSTRUMENTS) else self.step(gates)
            if made is None:
                continue
            told = [
                {"instrument": name, "tempo_bpm": t.tempo(), "period_sec": t.period, "phase": t.phase, "confidence_global": t.confidence, "warmup_complete": t.warm, "hits": [dict(zip(HIT.names, h)) for h in hits]}
                for name, t, hits in zip(INSTRUMENTS, self.trackers, made[1])
            ]
            out.append({"stream_id": stream, "frame_idx": frame, "timestamp_sec": made[0], "predictions": told})
        return pd.DataFrame(out, columns=OUTPUT.names)


def _predicted(batch: pa.RecordBatch, machine: InstrumentPredictor, params: PredictorParams) -> tuple[pa.RecordBatch, InstrumentPredictor]:
    """Messages of a batch's rows and the machine behind the last: columns of numbers, which Arrow nests."""
    nth, lists = batch.column("_nth").to_pylist(), batch.column("gates")
    rows, nows, states, hits, counts = [], [], [], [], []
    for i, gates in enumerate(lists.to_pylist()):
        if nth[i] == 1:
            machine = InstrumentPredictor(params)
        made = None if gates is None or len(gates) < len(INSTRUMENTS) else machine.step([g if g is not None else 0.0 for g in gates])
        if made is None:
            continue
        rows.append(i)
        nows.append(made[0])
        for t, told in zip(machine.trackers, made[1]):
            states.append((t.tempo(), t.period, t.phase, t.confidence, t.warm))
            hits += told
            counts.append(len(told))
    columns = lambda tuples, n: list(zip(*tuples)) if tuples else [()] * n
    place = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())
    doubles = lambda values: pa.array(values, pa.float64())
    h, s = columns(hits, 5), columns(states, 5)
    inner = pa.ListArray.from_arrays(place(counts), pa.StructArray.from_arrays([*map(doubles, h[:4]), pa.array(h[4], pa.int32())], HIT.names))
    told = pa.StructArray.from_arrays([pa.array(list(INSTRUMENTS) * len(rows), pa.string()), *map(doubles, s[:4]), pa.array(s[4], pa.bool_()), inner], PREDICTION.names)
    taken = pa.array(rows, pa.int64())
    outer = pa.ListArray.from_arrays(place([len(INSTRUMENTS)] * len(rows)), told)
    return pa.RecordBatch.from_arrays([batch.column("stream_id").take(taken), batch.column("frame_idx").take(taken), doubles(nows), outer], OUTPUT.names), machine


def instrument_predictor(frames: DataFrame, params: PredictorParams = PredictorParams()) -> DataFrame:
    """PredictionOutput rows (stream_id, frame_idx, timestamp_sec, predictions) of gate frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = InstrumentPredictor(params)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                made, machine = _predicted(batch.slice(at, ROWS), machine, params)
                yield made

    nth = F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_idx")).alias("_nth")
    return frames.select(F.col("stream_id").cast("long"), F.col("frame_idx").cast("long"), F.col("gates").cast("array<double>"), nth).mapInArrow(run, OUTPUT)


class BeatKalman:
    """Constant-period Kalman filter over beat times ``t``."""

    def __init__(self, params: BeatParams = BeatParams()):
        self.p, self.phase, self.period = params, None, params.init_period
        self.c = [1e-2, 0.0, 0.0, 1e-2]

    def step(self, t: float) -> None:
        if self.phase is None:
            self.phase = t
            return
        p11, p12, p21, p22 = self.c
        self.phase += self.period
        p11 += p12 + p21 + p22 + self.p.q_phase
        p12, p21 = p12 + p22, p21 + p22
        p22 += self.p.q_period
        y, s = t - self.phase, p11 + self.p.r_meas
        k1, k2 = p11 / s, p21 / s
        self.phase += k1 * y
        self.period = min(1.5, max(0.2, self.period + k2 * y))
        self.c = [(1 - k1) * p11, (1 - k1) * p12, p21 - k2 * p11, p22 - k2 * p12]

    def process(self, rows: pd.DataFrame) -> dict:
        phases, periods, stds = [], [], []
        for t in rows["t"].to_numpy(float).tolist():
            self.step(t)
            phases.append(self.phase)
            periods.append(self.period)
            stds.append(math.sqrt(max(self.c[0] + self.c[3] + self.p.r_meas, 1e-6)))
        return {"phase": phases, "period": periods, "std": stds}


def beat_kalman(beats: DataFrame, params: BeatParams = BeatParams()) -> DataFrame:
    """phase, period and std after every beat of (stream_id, frame_idx, t)."""
    d = T.DoubleType()
    schema = T.StructType([beats.schema["stream_id"], beats.schema["frame_idx"], *[T.StructField(n, d) for n in ("phase", "period", "std")]])
    return ordered_scan(beats.select("stream_id", "frame_idx", "t"), ["stream_id"], ["frame_idx"], lambda: BeatKalman(params), schema)


class ClockOffset:
    """Exponential mean of wall minus stream time; the first sample starts it."""

    def __init__(self, alpha: float = 0.1):
        self.alpha, self.offset = alpha, None

    def process(self, rows: pd.DataFrame) -> dict:
        out = []
        for d in (rows["wall"].to_numpy(float) - rows["t"].to_numpy(float)).tolist():
            self.offset = d if self.offset is None else (1 - self.alpha) * self.offset + self.alpha * d
            out.append(self.offset)
        return {"clock_offset": out}


def clock_offset(samples: DataFrame, alpha: float = 0.1) -> DataFrame:
    schema = T.StructType([samples.schema["stream_id"], samples.schema["frame_idx"], T.StructField("clock_offset", T.DoubleType())])
    return ordered_scan(samples.select("stream_id", "frame_idx", "t", "wall"), ["stream_id"], ["frame_idx"], lambda: ClockOffset(alpha), schema)


def hit_intervals(hits: DataFrame, low: float = 0.3, high: float = 4.0, last: int = 20) -> DataFrame:
    """For every hit (stream_id, instrument, frame_idx, t): the gap to the one before, the number of the last
    ``last`` hits, and the median and scaled MAD of the valid gaps among them (null below two)."""
    by = Window.partitionBy("stream_id", "instrument").orderBy("frame_idx")
    gap = F.col("t") - F.lag("t").over(by)
    recent = F.collect_list("t").over(by.rowsBetween(-(last - 1), 0))
    gaps = F.filter(F.zip_with(F.slice("_recent", 2, last), F.slice("_recent", 1, F.greatest(F.lit(0), F.size("_recent") - 1)), lambda b, a: F.round(b - a, 9)), lambda g: (g >= low) & (g <= high))
    out = hits.select("stream_id", "instrument", "frame_idx", "t", gap.alias("gap"), recent.alias("_recent"))
    # A generator of one row: filters and later columns read its results instead of sorting the gaps again.
    stats = F.transform(F.array(gaps), lambda g: F.struct(F.size(g).alias("n_valid"), F.when(F.size(g) >= 2, median_of(g)).alias("period_median"), g.alias("_gaps")))
    stats = F.transform(stats, lambda s: F.struct(s["n_valid"].alias("n_valid"), s["period_median"].alias("period_median"), F.when(s["n_valid"] >= 2, MAD_SCALE * mad_of(s["_gaps"], s["period_median"])).alias("period_mad")))
    return out.select("stream_id", "instrument", "frame_idx", "t", F.round("gap", 9).alias("gap"), F.size("_recent").alias("n_recent"), F.inline(stats))


def simple_forecast(intervals: DataFrame, k: int = 2) -> DataFrame:
    """Prediction rows by interval statistics alone: hit_index 1..k at t + n * median, confidence 1 - MAD / median."""
    known = intervals.where("period_median is not null")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("period_mad") / F.col("period_median")))
    half = 1.96 * F.greatest(F.lit(0.001), F.col("period_mad"))
    n = F.col("hit_index")
    rows = known.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("hit_index"))
    t = F.col("t") + n * F.col("period_median")
    return rows.select("stream_id", "instrument", "frame_idx", F.col("t").alias("now"), n.cast("int").alias("hit_index"), t.alias("t_pred_sec"), (t - half).alias("ci_low_sec"), (t + half).alias("ci_high_sec"), conf.alias("confidence"))
