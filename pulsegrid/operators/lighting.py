"""Commands from predictions: filters, first-wins duplicate suppression, colours, Unix times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import INSTRUMENTS, LightingParams


def flatten(outputs: DataFrame) -> DataFrame:
    """One row for each predicted hit: stream_id, frame_idx, now, instrument, hit_index, t_pred_sec, CI, confidence."""
    each = outputs.select("stream_id", "frame_idx", F.col("timestamp_sec").alias("now"), F.explode("predictions").alias("p"))
    return each.select("stream_id", "frame_idx", "now", F.col("p.instrument").alias("instrument"), F.explode("p.hits").alias("h")).select("stream_id", "frame_idx", "now", "instrument", "h.hit_index", "h.t_pred_sec", "h.ci_low_sec", "h.ci_high_sec", "h.confidence")


def confident(hits: DataFrame, least: float) -> DataFrame:
    return hits.where(F.col("confidence") >= least)


def in_time(hits: DataFrame, low: float, high: float) -> DataFrame:
    """Lead time within [low, high], rounded to nanoseconds."""
    return hits.where(F.round(F.col("t_pred_sec") - F.col("now"), 9).between(low, high))


def first_of_each_event(hits: DataFrame) -> DataFrame:
    """event_id added; of each (stream, event_id) the first by frame, instrument and hit index."""
    named = hits.withColumn("event_id", S.event_id(F.col("instrument"), F.col("t_pred_sec")))
    order = Window.partitionBy("stream_id", "event_id").orderBy("frame_idx", S.instrument_index(F.col("instrument"), len(INSTRUMENTS)), "hit_index")
    return named.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def commands(hits: DataFrame, params: LightingParams = LightingParams()) -> DataFrame:
    """Commands to send: confident, in time, not sent before, of the instruments to emit (which is checked last)."""
    kept = first_of_each_event(in_time(confident(hits, params.confidence_threshold), params.min_latency, params.max_latency))
    rgb = S.colour(F.col("instrument"))
    return kept.where(F.col("instrument").isin(*params.emit_instruments)).select("stream_id", "frame_idx", "instrument", "t_pred_sec", "confidence", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"), "event_id")


def unix_events(sent: DataFrame, start_sec: int, start_us: int) -> DataFrame:
    """Commands with unix_time and microseconds."""
    sec, us = S.unix_split(F.lit(start_sec), F.lit(start_us), F.col("t_pred_sec"))
    return sent.select("stream_id", sec.alias("unix_time"), us.alias("microseconds"), "confidence", "r", "g", "b", "event_id")


def payloads(events: DataFrame) -> DataFrame:
    """JSON text of every event."""
    return events.select("stream_id", F.to_json(F.struct("unix_time", "microseconds", "confidence", "r", "g", "b", "event_id")).alias("payload"))


def nearest_discard(new: DataFrame, tolerance: float = 0.003, horizon: float | None = None) -> DataFrame:
    """Predictions without an earlier kept one of the same stream, instrument and hit index within ``tolerance``.

    Whether one is kept depends on those kept before it, so rows are read in order of arrival (seq). With ``horizon``,
    kept times over that many seconds before a prediction are forgotten, which bounds the state of endless streams.
    """
    import pandas as pd
    from pyspark.sql import types as T

    from .scan import ordered_scan

    class Kept:
        def __init__(self):
            self.times: list[float] = []

        def process(self, rows: pd.DataFrame) -> pd.DataFrame:
            from bisect import bisect_left, insort

            keep = []
            for t in rows["t_pred_sec"].tolist():
                if horizon is not None:
                    del self.times[: bisect_left(self.times, t - horizon)]
                k = bisect_left(self.times, t)
                near = min((abs(t - self.times[j]) for j in (k - 1, k) if 0 <= j < len(self.times)), default=1e18)
                keep.append(near > tolerance)
                if keep[-1]:
                    insort(self.times, t)
            return rows[keep]

    keys = ["stream_id", "instrument", "hit_index"]
    return ordered_scan(new, keys, ["seq"], Kept, T.StructType(new.schema.fields))
