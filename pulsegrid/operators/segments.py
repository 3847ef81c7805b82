"""Scans of long streams, cut into segments that run side by side.

A recurrence's effect over a segment is a small map from the state before it to the state behind it: an affine map of an
exponential mean, a table over the few states of a refractory or a hysteresis, a clamped line of a difference that isn't negative. All
segments' maps are made in parallel; a stream's maps are applied one after the other, one row a segment; then all segments run
in parallel again, each from the state that it starts in. Windows reach into the segment before by a halo of rows.

Frames of a stream are numbered from 0 without gaps; a segment is ``length`` of them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import OnsetParams, QuantileParams
from .gates import OnsetGate
from .scan import ordered_scan, sliding_mean

LENGTH = 1 << 16
_MAP = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("map", T.BinaryType())])
_ENTRY = T.StructType([*_MAP.fields[:2], T.StructField("entry", T.BinaryType())])
_D, _L = T.DoubleType(), T.LongType()


class ExponentialMean:
    """y = (1 - alpha) * y + alpha * d; the first d starts it. The map: what the segment makes of no state, and (a, b) of a * y + b."""

    columns, outputs = ("d",), {"y": _D}

    def __init__(self, alpha: float = 0.1):
        self.alpha = alpha

    def start(self):
        return None

    def _walk(self, d: np.ndarray, y: float | None) -> list[float]:
        out = []
        for v in d.tolist():
            y = v if y is None else (1 - self.alpha) * y + self.alpha * v
            out.append(y)
        return out

    def summary(self, rows: dict[str, np.ndarray]):
        d = rows["d"]
        return self._walk(d, None)[-1], (1 - self.alpha) ** len(d), self._walk(d, 0.0)[-1]

    def after(self, made, y):
        fresh, a, b = made
        return fresh if y is None else a * y + b

    def run(self, rows: dict[str, np.ndarray], y) -> dict[str, np.ndarray]:
        return {"y": np.array(self._walk(rows["d"], y), float)}


class Blocking:
    """Candidates at least ``frames`` apart. State: how many frames to come are refused; the map is a table over 0 .. frames - 1."""

    columns, outputs = ("candidate",), {"hit": _L}

    def __init__(self, frames: int):
        self.frames = max(1, frames)

    def start(self):
        return 0

    def _chain(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """Places of candidates, and for each the number of the next one that is accepted if it is."""
        at = np.flatnonzero(rows["candidate"] >= 0.5)
        return at, np.searchsorted(at, at + self.frames)

    def summary(self, rows):
        n = len(rows["candidate"])
        at, following = self._chain(rows)
        left = [0] * len(at)
        for k in range(len(at) - 1, -1, -1):
            left[k] = left[following[k]] if following[k] < len(at) else max(0, int(at[k]) + self.frames - n)
        blocked = np.arange(self.frames)
        first = np.searchsorted(at, blocked)
        return [left[k] if k < len(at) else max(0, int(b) - n) for b, k in zip(blocked, first)]

    def after(self, table, blocked):
        return table[blocked]

    def run(self, rows, blocked):
        at, following = self._chain(rows)
        hit, k = np.zeros(len(rows["candidate"]), np.int64), int(np.searchsorted(at, blocked))
        while k < len(at):
            hit[at[k]] = 1
            k = int(following[k])
        return {"hit": hit}


class Hysteresis:
    """Arms where ``over`` holds, fires where ``under`` does while armed, then refuses to arm for ``frames`` frames; rows that
    aren't ``live`` only count down. States: how many frames are refused still (0 .. frames), or armed (frames + 1)."""

    columns, outputs = ("over", "under"), {"hit": _L}

    def __init__(self, frames: int):
        self.frames = frames

    def start(self):
        return 0

    def _events(self, rows) -> tuple[np.ndarray, np.ndarray]:
        return np.flatnonzero(rows["over"]), np.flatnonzero(rows["under"])

    def _first_fire(self, state: int, arms: np.ndarray, fires: np.ndarray) -> int | None:
        """Number of the fire that ends ``state`` at the segment's start: None if it stays unarmed, len(fires) if armed at the end."""
        if state == self.frames + 1:
            return 0
        k = int(np.searchsorted(arms, max(0, state - 1)))
        return int(np.searchsorted(fires, arms[k])) if k < len(arms) else None

    def _later(self, arms, fires) -> list[int | None]:
        k = np.searchsorted(arms, fires + max(1, self.frames))
        return [int(np.searchsorted(fires, arms[i])) if i < len(arms) else None for i in k.tolist()]

    def summary(self, rows):
        n = len(rows["over"])
        arms, fires = self._events(rows)
        later, end = self._later(arms, fires), [0] * len(fires)
        for f in range(len(fires) - 1, -1, -1):
            g = later[f]
            end[f] = max(0, self.frames - (n - 1 - int(fires[f]))) if g is None else self.frames + 1 if g >= len(fires) else end[g]
        table = []
        for state in range(self.frames + 2):
            f = self._first_fire(state, arms, fires)
            table.append(max(0, state - n) if f is None else self.frames + 1 if f >= len(fires) else end[f])
        return table

    def after(self, table, state):
        return table[state]

    def run(self, rows, state):
        arms, fires = self._events(rows)
        later, hit = self._later(arms, fires), np.zeros(len(rows["over"]), np.int64)
        f = self._first_fire(state, arms, fires)
        while f is not None and f < len(fires):
            hit[fires[f]] = 1
            f = later[f]
        return {"hit": hit}


class Strength:
    """o = max(0, x - o), o = 0 for the first ``needs`` - 1 values. A segment's map is a line of slope 1 or -1 between two limits: the results
    from 0 and from infinity. Where these agree, as they do once x falls below an earlier o, the state behind is the same number that a
    walk over the whole stream gives; else it may differ in the last digits."""

    columns, outputs = ("x",), {"odf": _D}

    def __init__(self, needs: int, reaches: bool):
        self.needs, self.reaches = needs, reaches

    def start(self):
        return (0, 0.0)  # values seen, as far as it matters, and the last o

    def _walk(self, x: np.ndarray, state) -> tuple[np.ndarray, tuple]:
        seen, o = state
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            o = max(0.0, v - o) if self.reaches and seen >= self.needs else 0.0
            out[i] = o
            seen += 1
        return out, (min(seen, self.needs), o)

    def summary(self, rows):
        x = rows["x"]
        signs = (-1.0) ** np.arange(len(x) - 1, -1, -1)
        late = [self._walk(x, (self.needs, o))[1][1] for o in (0.0, math.inf)]
        early = [self._walk(x, (k, 0.0))[1] for k in range(self.needs)]  # the beginning of a stream
        return early, min(late), max(late), float((-1.0) ** len(x)), float((signs * x).sum())

    def after(self, made, state):
        early, low, high, slope, shift = made
        seen, o = state
        if seen < self.needs:
            return early[seen]
        return (self.needs, low if low == high else min(high, max(low, slope * o + shift)))

    def run(self, rows, state):
        return {"odf": self._walk(rows["x"], state)[0]}


class _Gathered:
    """Rows of one segment as arrays, handed over when the segment ends; a segment is bounded."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns, self.parts = columns, []

    def scan(self, rows: dict[str, np.ndarray]) -> None:
        self.parts.append(rows)

    def whole(self, name: str) -> np.ndarray:
        return self.parts[0][name] if len(self.parts) == 1 else np.concatenate([p[name] for p in self.parts])

    def rows(self) -> dict[str, np.ndarray]:
        return {c: self.whole(c).astype(float, copy=False) for c in self.columns}


class _Summaries(_Gathered):
    def __init__(self, recurrence):
        super().__init__(recurrence.columns)
        self.recurrence = recurrence

    def ends(self) -> dict:
        first = self.parts[0]
        return {"stream_id": first["stream_id"][:1], "segment": first["segment"][:1], "map": [pickle.dumps(self.recurrence.summary(self.rows()))]}


class _Entries:
    """States that a stream's segments start in, from their maps in order."""

    def __init__(self, recurrence):
        self.recurrence, self.state = recurrence, recurrence.start()

    def scan(self, rows: dict[str, np.ndarray]) -> dict:
        entries = []
        for made in rows["map"]:
            entries.append(pickle.dumps(self.state))
            self.state = self.recurrence.after(pickle.loads(made), self.state)
        return {"stream_id": rows["stream_id"], "segment": rows["segment"], "entry": entries}

    def ends(self) -> None:
        return None


class _Runs(_Gathered):
    def __init__(self, recurrence):
        super().__init__(recurrence.columns)
        self.recurrence = recurrence

    def ends(self) -> dict:
        made = self.recurrence.run(self.rows(), pickle.loads(self.parts[0]["entry"][0]))
        return {"stream_id": self.whole("stream_id"), "frame_idx": self.whole("frame_idx"), **made}


def _segmented(frames: DataFrame, length: int) -> DataFrame:
    return frames.withColumn("segment", F.floor(F.col("frame_idx") / length).cast("long"))


def segmented_scan(frames: DataFrame, recurrence, length: int = LENGTH) -> DataFrame:
    """stream_id, frame_idx and the recurrence's outputs of every row of ``frames`` (stream_id, frame_idx and its columns).

    Rows are shuffled by stream and segment, so one stream uses all cores; what a stream gathers is one map a segment.
    """
    rows = _segmented(frames.select("stream_id", "frame_idx", *recurrence.columns), length)
    key = ["stream_id", "segment"]
    maps = ordered_scan(rows, key, ["frame_idx"], lambda: _Summaries(recurrence), _MAP)

    entries = ordered_scan(maps, ["stream_id"], ["segment"], lambda: _Entries(recurrence), _ENTRY)
    schema = T.StructType([T.StructField("stream_id", _L), T.StructField("frame_idx", _L), *[T.StructField(n, t) for n, t in recurrence.outputs.items()]])
    return ordered_scan(rows.join(entries, key), key, ["frame_idx"], lambda: _Runs(recurrence), schema)


class _Halo(_Gathered):
    """Rows of a segment behind those of its halo: ``fn`` sees both, the segment's own rows are given."""

    def __init__(self, columns: tuple[str, ...], fn: Callable, outputs: tuple[str, ...]):
        super().__init__(columns)
        self.fn, self.outputs = fn, outputs

    def ends(self) -> dict:
        own, at = self.whole("own").astype(bool), self.whole("frame_idx")
        made = self.fn(self.rows(), at)
        return {"stream_id": self.whole("stream_id")[own], "frame_idx": at[own], **{n: v[own] for n, v in made.items()}}


def halo_scan(frames: DataFrame, columns: tuple[str, ...], before: int, fn: Callable[[dict, np.ndarray], dict], outputs: dict[str, T.DataType], length: int = LENGTH) -> DataFrame:
    """What ``fn`` (columns, frame numbers) makes of every row if each looks back ``before`` rows at most: a segment's task gets
    its rows and the last ``before`` ones in front of it, which go to two tasks (``before`` must be less than ``length``)."""
    if not 0 <= before < length:
        raise ValueError("before must be less than length")
    rows = _segmented(frames.select("stream_id", "frame_idx", *columns), length)
    late = F.col("frame_idx") % length >= length - before
    both = F.when(late, F.array(F.struct("segment", F.lit(True).alias("own")), F.struct((F.col("segment") + 1).alias("segment"), F.lit(False).alias("own")))).otherwise(F.array(F.struct("segment", F.lit(True).alias("own"))))
    dealt = rows.withColumn("to", both).select("stream_id", "frame_idx", *columns, F.inline("to"))
    schema = T.StructType([T.StructField("stream_id", _L), T.StructField("frame_idx", _L), *[T.StructField(n, t) for n, t in outputs.items()]])
    return ordered_scan(dealt, ["stream_id", "segment"], ["frame_idx"], lambda: _Halo(columns, fn, tuple(outputs)), schema)


def clock_offset(samples: DataFrame, alpha: float = 0.1, length: int = LENGTH) -> DataFrame:
    """``tracking.clock_offset`` of streams of any length; equal up to rounding."""
    d = samples.select("stream_id", "frame_idx", (F.col("wall") - F.col("t")).alias("d"))
    return segmented_scan(d, ExponentialMean(alpha), length).withColumnRenamed("y", "clock_offset")


def refractory(frames: DataFrame, frames_apart: int, length: int = LENGTH) -> DataFrame:
    """``gates.refractory`` of streams of any length."""
    return segmented_scan(frames, Blocking(frames_apart), length)


def quantile_gate(frames: DataFrame, params: QuantileParams = QuantileParams(), length: int = LENGTH) -> DataFrame:
    """``gates.quantile_gate`` (``reference``) of streams of any length: the first seven values fix both thresholds."""
    if params.compat != "reference":
        raise ValueError("thresholds of all of the past have no small map; use gates.quantile_gate")
    early = frames.where("frame_idx < 7").groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))), lambda r: r["x"]).alias("e"))
    e = lambda i: F.get("e", F.lit(i))
    mid = lambda *v: F.get(F.sort_array(F.array(*v)), F.lit(2))
    limits = early.where(F.size("e") == 7).select("stream_id", mid(e(0), e(0), e(1), e(1), e(2)).alias("hi"), mid(*[e(i) for i in range(2, 7)]).alias("lo"))
    live = F.col("hi").isNotNull() & (F.col("frame_idx") + 1 > params.warmup) & (F.col("frame_idx") >= 6)
    marked = frames.select("stream_id", "frame_idx", "x").join(limits, "stream_id", "left")
    flags = marked.select("stream_id", "frame_idx", F.coalesce(live & (F.col("x") > F.col("hi")), F.lit(False)).cast("double").alias("over"), F.coalesce(live & (F.col("x") < F.col("lo")), F.lit(False)).cast("double").alias("under"))
    return segmented_scan(flags, Hysteresis(params.refractory), length)


def onset_gate(frames: DataFrame, params: OnsetParams = OnsetParams(), length: int = LENGTH) -> DataFrame:
    """stream_id, frame_idx and hit of ``gates.onset_gate`` for streams of any length: strengths by clamped lines, mean, median and edge by a
    halo of rows, the refractory by its table."""
    p, skip = params, max(0, params.warmup - 1)
    live = frames.where(F.col("frame_idx") >= skip).select("stream_id", (F.col("frame_idx") - skip).alias("frame_idx"), "x")
    if p.method == "rms":
        strength = live.withColumnRenamed("x", "odf")
    elif p.compat == "textbook":
        needs = 2 if p.method in ("hfc", "flux") else 1

        def differences(c: dict, at: np.ndarray) -> dict:
            d = np.maximum(0.0, c["x"] - np.concatenate(([0.0], c["x"][:-1])))
            return {"odf": np.where((at >= needs) & (p.smooth_window >= needs), d, 0.0)}

        strength = halo_scan(live, ("x",), 1, differences, {"odf": _D}, length)
    else:
        needs = 2 if p.method in ("hfc", "flux") else 1
        strength = segmented_scan(live, Strength(needs, p.smooth_window >= needs), length)

    def edges(c: dict, at: np.ndarray) -> dict:
        gate = OnsetGate(params)  # a new one: its windows fill from the halo
        joined, before = gate.odf_tail.extend(c["odf"])
        smoothed = sliding_mean(joined, before, p.smooth_window)
        return {"candidate": gate.edges(smoothed, gate.thresholds(smoothed)).astype(float)}

    candidates = halo_scan(strength, ("odf",), p.smooth_window + p.odf_window, edges, {"candidate": _D}, length)
    hits = segmented_scan(candidates, Blocking(p.refractory), length)
    shifted = hits.select("stream_id", (F.col("frame_idx") + skip).alias("frame_idx"), "hit")
    early = frames.where(F.col("frame_idx") < skip).select("stream_id", "frame_idx", F.lit(0).cast("long").alias("hit"))
    return shifted.unionByName(early)
