"""The timed device queue: admission, due order, flashes and the LED timeline."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import QueueParams
from .scan import ordered_scan


def due_order(events: DataFrame) -> DataFrame:
    """position of every event of its stream by execute_time_us; equal times in the order of arrival (seq)."""
    return events.withColumn("position", F.row_number().over(Window.partitionBy("stream_id").orderBy("execute_time_us", "seq")))


def led_timeline(events: DataFrame, flash_us: int = 150_000) -> DataFrame:
    """Intervals (from_us, to_us, red, green, blue) between executions: each event sets all three channels, and a lit
    one is followed by all off after ``flash_us``. The last interval ends with null."""
    on = events.select("stream_id", F.col("execute_time_us").alias("at"), "seq", F.lit(0).alias("off"), "red", "green", "blue")
    off = on.where("red or green or blue").select("stream_id", (F.col("at") + flash_us).alias("at"), "seq", F.lit(1).alias("off"), *[F.lit(False).alias(c) for c in ("red", "green", "blue")])
    by = Window.partitionBy("stream_id").orderBy("at", "off", "seq")
    return on.unionByName(off).select("stream_id", F.col("at").alias("from_us"), F.lead("at").over(by).alias("to_us"), "red", "green", "blue")


EXECUTION = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("at_us", T.LongType()), T.StructField("event_id", T.IntegerType()), T.StructField("kind", T.StringType()), *[T.StructField(c, T.BooleanType()) for c in ("red", "green", "blue")]])


class DeviceQueue:
    """Bounded queue sorted by due time. A full queue rejects new events, all-off events included; past-due events run at once.

    Rows are arrivals in order: arrival_us, execute_time_us, red, green, blue, event_id. Executions happen at exact due times.
    """

    def __init__(self, params: QueueParams = QueueParams()):
        self.p, self.queue, self.stream, self.now = params, [], None, None

    def insert(self, due: int, event: tuple) -> bool:
        if len(self.queue) >= self.p.capacity:
            return False
        self.queue.insert(bisect_right([d for d, _ in self.queue], due), (due, event))
        return True

    def run_until(self, now: int | None) -> list[dict]:
        out = []
        while self.queue and (now is None or self.queue[0][0] <= now):
            due, (event_id, kind, r, g, b) = self.queue[0]
            at = due if self.now is None else max(due, self.now)
            out.append({"stream_id": self.stream, "at_us": at, "event_id": event_id, "kind": kind, "red": r, "green": g, "blue": b})
            if r or g or b:  # the flash's end is queued before its own entry is freed
                self.insert(at + self.p.flash_us, (event_id, "off", False, False, False))
            self.queue.remove((due, (event_id, kind, r, g, b)))
        return out

    def process(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for stream, arrival, due, r, g, b, event_id in zip(*(rows[c].tolist() for c in ("stream_id", "arrival_us", "execute_time_us", "red", "green", "blue", "event_id"))):
            self.stream = stream
            out += self.run_until(arrival)
            self.now = arrival
            if not self.insert(due, (event_id % 256, "on", r, g, b)):
                out.append({"stream_id": stream, "at_us": arrival, "event_id": event_id % 256, "kind": "rejected", "red": r, "green": g, "blue": b})
        return pd.DataFrame(out, columns=EXECUTION.names)

    def finish(self) -> pd.DataFrame:
        return pd.DataFrame(self.run_until(None), columns=EXECUTION.names)


def device_queue(arrivals: DataFrame, params: QueueParams = QueueParams()) -> DataFrame:
    """What the device does: executions (on/off) and rejections, by stream."""
    columns = ["stream_id", "arrival_us", "seq", "execute_time_us", "red", "green", "blue", "event_id"]
    return ordered_scan(arrivals.select(*columns), ["stream_id"], ["arrival_us", "seq"], lambda: DeviceQueue(params), EXECUTION)


def scheduled_release(predictions: DataFrame) -> DataFrame:
    """Predictions still in the future when made, in due order (release_no), with their waiting time."""
    by = Window.partitionBy("stream_id").orderBy("t_pred_sec", "instrument", "frame_idx", "hit_index")
    return predictions.where("t_pred_sec > now").select("stream_id", "instrument", "frame_idx", "hit_index", "t_pred_sec", F.round(F.col("t_pred_sec") - F.col("now"), 6).alias("wait"), F.row_number().over(by).alias("release_no"))


def visual_intervals(hits: DataFrame, duration: float = 0.12) -> DataFrame:
    """Visuals' lives: shown_at, gone_at."""
    return hits.select("stream_id", "frame_idx", "instrument", F.col("t").alias("shown_at"), F.round(F.col("t") + duration, 6).alias("gone_at"))
