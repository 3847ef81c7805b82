"""Onset gates: adaptive median/MAD, per band, multi-frame, quantile hysteresis, and refractory control.

All machines take a column ``x`` in frame order and give ``hit`` 0/1 (and what else the operator shows).
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import MultiFrameParams, OnsetParams, OnsetVectorParams, QuantileParams
from .scan import Tail, ordered_scan, sliding_mean, trailing_medians

KEY, FRAME = "stream_id", "frame_idx"
LEAST_WINDOW = 8
DEFAULT_FACTOR = 0.3


class Refractory:
    """Accepts a candidate if at least ``frames`` frames passed since the last accepted one."""

    def __init__(self, frames: int):
        self.frames, self.seen, self.last = frames, 0, None

    def accept(self, candidate: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(candidate), np.int64)
        for i in np.flatnonzero(candidate).tolist():
            at = self.seen + i
            if self.last is None or at - self.last >= self.frames:
                hit[i], self.last = 1, at
        self.seen += len(candidate)
        return hit

    def process(self, rows: pd.DataFrame) -> dict:
        return {"hit": self.accept(rows["candidate"].to_numpy(float) >= 0.5)}


class OnsetGate:
    """Onset strength, its trailing mean, an adaptive threshold, and rising edges through it."""

    default_factor = DEFAULT_FACTOR

    def __init__(self, params: OnsetParams = OnsetParams()):
        self.p, self.seen = params, 0
        self.needs = 2 if params.method in ("hfc", "flux") else 1
        self.n_odf, self.last_odf, self.last_x = 0, 0.0, 0.0
        self.odf_tail, self.smooth_tail = Tail(params.smooth_window - 1), Tail(params.odf_window - 1)
        self.was_above, self.prev = False, 0.0
        self.refractory = Refractory(params.refractory)

    def strength(self, x: np.ndarray) -> np.ndarray:
        """The history that a difference reads holds earlier strengths (textbook: earlier inputs), at most
        ``smooth_window`` of them."""
        p = self.p
        if p.method == "rms":
            return x.astype(float)
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            before = self.last_x if p.compat == "textbook" else self.last_odf
            o = max(0.0, v - before) if min(self.n_odf, p.smooth_window) >= self.needs else 0.0
            out[i], self.last_odf, self.last_x = o, o, v
            self.n_odf += 1
        return out

    def thresholds(self, smoothed: np.ndarray) -> np.ndarray:
        p = self.p
        joined, before = self.smooth_tail.extend(smoothed)
        factor = p.threshold if p.threshold > 0 else self.default_factor
        m, mad, count = trailing_medians(joined, before, p.odf_window)
        return np.where(count < LEAST_WINDOW, p.threshold, m + factor * np.maximum(1e-6, mad))

    def edges(self, smoothed: np.ndarray, limit: np.ndarray) -> np.ndarray:
        above = smoothed > limit
        was = np.concatenate(([self.was_above], above[:-1]))
        prev = np.concatenate(([self.prev], smoothed[:-1]))
        if len(above):
            self.was_above, self.prev = bool(above[-1]), float(smoothed[-1])
        return above & ~was & (smoothed >= prev)

    def process(self, rows: pd.DataFrame) -> dict:
        x = rows["x"].to_numpy(float)
        skip = min(len(x), max(0, self.p.warmup - 1 - self.seen))
        self.seen += len(x)
        odf, smoothed, limit, edge = (np.full(len(x), np.nan) for _ in range(4))
        edge = np.zeros(len(x), bool)
        if skip < len(x):
            odf[skip:] = self.strength(x[skip:])
            joined, before = self.odf_tail.extend(odf[skip:])
            smoothed[skip:] = sliding_mean(joined, before, self.p.smooth_window)
            limit[skip:] = self.thresholds(smoothed[skip:])
            edge[skip:] = self.edges(smoothed[skip:], limit[skip:])
        return {"odf": odf, "smoothed": smoothed, "threshold": limit, "hit": self.refractory.accept(edge)}


class OnsetBandGate(OnsetGate):
    """One band of the vector gate: histories move during warm-up too, with the raw difference strength."""

    default_factor = 1.0

    def __init__(self, params: OnsetVectorParams = OnsetVectorParams()):
        super().__init__(params)
        self.needs = 1

    def process(self, rows: pd.DataFrame) -> dict:
        x, p = rows["x"].to_numpy(float), self.p
        skip = min(len(x), max(0, p.warmup - 1 - self.seen))
        self.seen += len(x)
        hit = np.zeros(len(x), bool)
        for v in x[:skip].tolist():
            o = max(0.0, v - self.last_odf) if self.n_odf else 0.0
            self.n_odf, self.last_odf, self.prev, self.was_above = self.n_odf + 1, o, o, False
            self.odf_tail.extend(np.array([o]))
            self.smooth_tail.extend(np.array([o]))
        if skip < len(x):
            if p.method == "rms":
                odf = x[skip:]
                self.last_odf, self.n_odf = float(odf[-1]), self.n_odf + len(odf)
            else:
                odf = self.strength(x[skip:])
            joined, before = self.odf_tail.extend(odf)
            smoothed = sliding_mean(joined, before, p.smooth_window)
            hit[skip:] = self.edges(smoothed, self.thresholds(smoothed))
        return {"hit": self.refractory.accept(hit)}


class QuantileGate:
    """Arms above a high threshold and fires below a low one.

    ``reference``: both thresholds are medians of fixed early samples, {x1, x1, x2, x2, x3} from frame 3
    and {x3 .. x7} from frame 7. ``textbook``: exact running quantiles q_hi and q_lo, for which all values are kept.
    """

    def __init__(self, params: QuantileParams = QuantileParams()):
        self.p, self.seen, self.early, self.sorted = params, 0, [], []
        self.armed, self.ref = False, 0

    def limits(self) -> tuple[float, float] | None:
        if self.p.compat == "textbook":
            return tuple(self._quantile(q) for q in (self.p.q_hi, self.p.q_lo)) if self.sorted else None
        if len(self.early) < 7:
            return None
        a, b, c = self.early[:3]
        return sorted((a, a, b, b, c))[2], sorted(self.early[2:7])[2]

    def _quantile(self, q: float) -> float:
        at = q * (len(self.sorted) - 1)
        low = self.sorted[int(at)]
        return low + (at - int(at)) * (self.sorted[min(int(at) + 1, len(self.sorted) - 1)] - low)

    def process(self, rows: pd.DataFrame) -> dict:
        hit = np.zeros(len(rows), np.int64)
        for i, x in enumerate(rows["x"].to_numpy(float).tolist()):
            self.seen += 1
            if self.p.compat == "textbook":
                insort(self.sorted, x)
            elif len(self.early) < 7:
                self.early.append(x)
            self.ref = max(0, self.ref - 1)
            limits = self.limits() if self.seen > self.p.warmup else None
            if limits:
                high, low = limits
                if not self.armed and self.ref == 0 and x > high:
                    self.armed = True
                if self.armed and x < low:
                    hit[i], self.armed, self.ref = 1, False, self.p.refractory
        return {"hit": hit}


class MultiFrameGate:
    """The multi-frame votes of ``multiframe_candidates`` for a stream: the last ``window_size`` values are its state."""

    def __init__(self, params: MultiFrameParams = MultiFrameParams()):
        self.p, self.seen, self.tail = params, 0, Tail(params.window_size - 1)
        self.refractory = Refractory(params.refractory)

    def votes(self, w: np.ndarray) -> tuple[bool, bool, bool]:
        p, n, mid = self.p, len(w), len(w) // 2
        past, first, second = w[:-1], w[:mid], w[mid:]
        sd = past.std(ddof=1) if n >= 3 else 0.0
        peak = n >= 3 and sd >= 1e-6 and (w[-1] - past.mean()) / sd > p.peak_threshold
        trend = n >= 4 and (1.0 if first.mean() < 1e-6 else second.mean() / first.mean()) > p.trend_threshold
        var = first.var(ddof=1) if n >= 6 else 0.0
        return bool(peak), bool(trend), bool(n >= 6 and var >= 1e-6 and second.var(ddof=1) / var > p.variance_threshold)

    def process(self, rows: pd.DataFrame) -> dict:
        x, p, n = rows["x"].to_numpy(float), self.p, self.p.window_size
        joined, before = self.tail.extend(x)
        fired = np.zeros(len(x), bool)
        for i in range(len(x)):
            end = before + i + 1
            if end >= n and self.seen + i + 1 >= p.warmup:
                votes = self.votes(joined[end - n : end])
                fired[i] = {"peak": votes[0], "trend": votes[1], "variance": votes[2], "combined": sum(votes) >= 2}.get(p.detection_mode, False)
        self.seen += len(x)
        return {"hit": self.refractory.accept(fired)}


def _schema(df: DataFrame, extra: list[tuple[str, T.DataType]]) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name in (KEY, FRAME, "band")]
    return T.StructType(kept + [T.StructField(n, t) for n, t in extra])


def onset_gate(frames: DataFrame, params: OnsetParams = OnsetParams()) -> DataFrame:
    """stream_id, frame_idx, odf, smoothed, threshold (null before the warm-up ends) and hit."""
    d = T.DoubleType()
    schema = _schema(frames, [("odf", d), ("smoothed", d), ("threshold", d), ("hit", T.LongType())])
    return ordered_scan(frames.select(KEY, FRAME, "x"), [KEY], [FRAME], lambda: OnsetGate(params), schema)


def onset_gate_vector(frames: DataFrame, params: OnsetVectorParams = OnsetVectorParams()) -> DataFrame:
    """stream_id, frame_idx, band and hit for the ``bands`` vectors; empty vectors aren't counted, and where the number of
    bands changes all bands start anew."""
    by = Window.partitionBy(KEY).orderBy(FRAME)
    some = frames.where(F.size("bands") > 0).select(KEY, FRAME, "bands", (F.size("bands") != F.lag(F.size("bands")).over(by)).cast("int").alias("_new"))
    runs = some.withColumn("_run", F.coalesce(F.sum("_new").over(by), F.lit(0)))
    bands = runs.select(KEY, FRAME, "_run", F.posexplode("bands").alias("band", "x"))
    return ordered_scan(bands, [KEY, "band", "_run"], [FRAME], lambda: OnsetBandGate(params), _schema(bands, [("hit", T.LongType())]))


def refractory(frames: DataFrame, frames_apart: int) -> DataFrame:
    """hit for rows with a 0/1 column ``candidate``."""
    return ordered_scan(frames.select(KEY, FRAME, "candidate"), [KEY], [FRAME], lambda: Refractory(frames_apart), _schema(frames, [("hit", T.LongType())]))


def quantile_gate(frames: DataFrame, params: QuantileParams = QuantileParams()) -> DataFrame:
    return ordered_scan(frames.select(KEY, FRAME, "x"), [KEY], [FRAME], lambda: QuantileGate(params), _schema(frames, [("hit", T.LongType())]))


def multiframe_candidates(frames: DataFrame, params: MultiFrameParams = MultiFrameParams()) -> DataFrame:
    """peak, trend, variance (booleans) and candidate by window functions over the last ``window_size`` frames."""
    n = params.window_size
    mid = n // 2
    by = Window.partitionBy(KEY).orderBy(FRAME)
    past = by.rowsBetween(-(n - 1), -1)
    first, second = by.rowsBetween(-(n - 1), -(n - mid)), by.rowsBetween(-(n - mid - 1), 0)
    x = F.col("x")
    seen, full = F.row_number().over(by), F.count(F.lit(1)).over(by.rowsBetween(-(n - 1), 0)) == n
    no = F.lit(False)
    sd = F.stddev_samp("x").over(past)
    peak = F.when(sd >= 1e-6, (x - F.avg("x").over(past)) / sd > params.peak_threshold).otherwise(no) if n >= 3 else no
    low = F.avg("x").over(first)
    trend = F.when(low < 1e-6, F.lit(1.0)).otherwise(F.avg("x").over(second) / low) > params.trend_threshold if n >= 4 else no
    var = F.var_samp("x").over(first)
    variance = F.when(var >= 1e-6, F.var_samp("x").over(second) / var > params.variance_threshold).otherwise(no) if n >= 6 else no
    votes = F.col("peak").cast("int") + F.col("trend").cast("int") + F.col("variance").cast("int")
    fired: dict[str, Column] = {"peak": F.col("peak"), "trend": F.col("trend"), "variance": F.col("variance"), "combined": votes >= 2}
    ready = frames.select(KEY, FRAME, "x", (seen >= params.warmup).alias("_warm"), full.alias("_full"), F.coalesce(peak, no).alias("peak"), F.coalesce(trend, no).alias("trend"), F.coalesce(variance, no).alias("variance"))
    return ready.select(KEY, FRAME, "peak", "trend", "variance", (F.col("_warm") & F.col("_full") & fired.get(params.detection_mode, no)).cast("int").alias("candidate"))


def multiframe_gate(frames: DataFrame, params: MultiFrameParams = MultiFrameParams()) -> DataFrame:
    return refractory(multiframe_candidates(frames, params), params.refractory)
