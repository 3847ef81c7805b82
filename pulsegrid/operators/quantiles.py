"""Running quantiles: five moving markers in constant memory, exact ones by two heaps, and mergeable sketches of groups."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import ordered_scan


class Markers:
    """The P2 estimate of one quantile: least, half-way, quantile, half-way and greatest marker.

    A marker that is a place or more away from where it should stand moves one place by a parabola through its neighbours, or
    by a line where the parabola would leave them. The first five values are exact.
    """

    def __init__(self, q: float):
        self.q, self.count = q, 0
        self.want = (0.0, q / 2, q, (1 + q) / 2, 1.0)
        self.height: list[float] = []
        self.place = [1, 2, 3, 4, 5]

    def add(self, x: float) -> None:
        self.count += 1
        h, n = self.height, self.place
        if self.count <= 5:
            h.append(x)
            h.sort()
            return
        cell = sum(x >= v for v in h[1:4])
        h[0], h[4] = min(h[0], x), max(h[4], x)
        for i in range(cell + 1, 5):
            n[i] += 1
        for i in (1, 2, 3):
            off = 1 + self.want[i] * (self.count - 1) - n[i]
            if off >= 1 and n[i + 1] - n[i] > 1:
                self._move(i, 1)
            elif off <= -1 and n[i] - n[i - 1] > 1:
                self._move(i, -1)

    def _move(self, i: int, d: int) -> None:
        h, n = self.height, self.place
        right, left = (h[i + 1] - h[i]) / (n[i + 1] - n[i]), (h[i] - h[i - 1]) / (n[i] - n[i - 1])
        to = h[i] + d / (n[i + 1] - n[i - 1]) * ((n[i] - n[i - 1] + d) * right + (n[i + 1] - n[i] - d) * left)
        if not h[i - 1] < to < h[i + 1]:
            to = h[i] + d * (h[i + d] - h[i]) / (n[i + d] - n[i])
        h[i] = to
        n[i] += d

    def value(self) -> float:
        if not self.count:
            return math.nan
        if self.count > 5:
            return self.height[2]
        at = self.q * (self.count - 1)
        low = int(at)
        return self.height[low] + (at - low) * (self.height[min(low + 1, self.count - 1)] - self.height[low])


class Heaps:
    """An exact running quantile: the values up to its place in one heap, the others in a second. Keeps all values."""

    def __init__(self, q: float):
        self.q, self.low, self.high = q, [], []

    def add(self, x: float) -> None:
        if self.low and x <= -self.low[0]:
            heapq.heappush(self.low, -x)
        else:
            heapq.heappush(self.high, x)
        keep = int(self.q * (len(self.low) + len(self.high) - 1)) + 1
        while len(self.low) > keep:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        while len(self.low) < keep:
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float:
        if not self.low:
            return math.nan
        at = self.q * (len(self.low) + len(self.high) - 1)
        low = -self.low[0]
        return low + (at - int(at)) * (self.high[0] - low) if at > int(at) else low


class RunningQuantiles:
    """hi and lo after every x; missing values change nothing."""

    def __init__(self, q_hi: float, q_lo: float, exact: bool):
        self.hi, self.lo = ((Heaps if exact else Markers)(q) for q in (q_hi, q_lo))

    def process(self, rows: pd.DataFrame) -> dict:
        hi, lo = np.empty(len(rows)), np.empty(len(rows))
        for i, x in enumerate(rows["x"].to_numpy(float).tolist()):
            if not math.isnan(x):
                self.hi.add(x)
                self.lo.add(x)
            hi[i], lo[i] = self.hi.value(), self.lo.value()
        return {"hi": hi, "lo": lo}


OUT = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("frame_idx", T.LongType()), T.StructField("hi", T.DoubleType()), T.StructField("lo", T.DoubleType())])


def running_quantiles(frames: DataFrame, q_hi: float = 0.98, q_lo: float = 0.8, exact: bool = True) -> DataFrame:
    """Quantiles of all x of a stream so far: interpolated exact ones in n log n (all values are kept), or those of five markers (no
    more than ten numbers are kept)."""
    return ordered_scan(frames.select("stream_id", "frame_idx", "x"), ["stream_id"], ["frame_idx"], lambda: RunningQuantiles(q_hi, q_lo, exact), OUT)


def quantile_sketches(values: DataFrame, keys: list[str], column: str = "value", k: int = 200) -> DataFrame:
    """``keys`` and ``sketch``: a mergeable rank sketch (KLL) of each group, of bounded size whatever the group's is."""
    return values.groupBy(*keys).agg(F.expr(f"kll_sketch_agg_double(cast(`{column}` as double), {k})").alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*keys).agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, ranks: list[float]) -> DataFrame:
    """The sketches' keys, n and the values at ``ranks`` (``q0``, ``q1``, ...)."""
    columns = [F.expr(f"kll_sketch_get_quantile_double(sketch, {float(q)}D)").alias(f"q{i}") for i, q in enumerate(ranks)]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], F.expr("kll_sketch_get_n_double(sketch)").alias("n"), *columns)
