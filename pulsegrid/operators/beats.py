"""Beats: filters, intervals, counters, delayed shows, generators, and queue policies as ranked limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Shortest and longest interval that counts, and how many intervals are remembered.
SHORTEST_IBI, LONGEST_IBI, REMEMBERED = 0.2, 1.5, 8
#: Red, green and blue of the colour pattern, in order.
COLOURS = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1))


def beats_only(rows: DataFrame) -> DataFrame:
    """Rows of (time, flag) whose flag is 1."""
    return rows.where(F.col("flag") == 1)


def intervals(beats: DataFrame) -> DataFrame:
    """For every beat (stream_id, frame_idx, t): beat_no from 1, ibi (to the beat before, null at the first), ibi_valid,
    and recent_ibis, the last valid ones up to this beat, oldest first."""
    by = Window.partitionBy("stream_id").orderBy("frame_idx")
    ibi = F.round(F.col("t") - F.lag("t").over(by), 9)
    timed = beats.select("stream_id", "frame_idx", "t", F.row_number().over(by).cast("long").alias("beat_no"), ibi.alias("ibi"))
    timed = timed.withColumn("ibi_valid", F.coalesce(F.col("ibi").between(SHORTEST_IBI, LONGEST_IBI), F.lit(False)))
    # The window counts beats; of those with a valid interval the last REMEMBERED are kept, found by their own number.
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    valid = timed.withColumn("_no", F.sum(F.col("ibi_valid").cast("long")).over(so_far))
    near = Window.partitionBy("stream_id").orderBy("_no").rangeBetween(-(REMEMBERED - 1), 0)
    kept = F.collect_list(F.when(F.col("ibi_valid"), F.struct("_no", "ibi"))).over(near)
    return valid.withColumn("recent_ibis", F.transform(F.array_sort(kept), lambda x: x["ibi"])).drop("_no")


def first_of_each_beat(events: DataFrame) -> DataFrame:
    """Of events (stream_id, t, event_type, frame_idx) the first frame of each time, rounded to hundredths half to even, and type."""
    return events.groupBy("stream_id", F.bround("t", 2).alias("beat_time"), "event_type").agg(F.min("frame_idx").alias("frame_idx"))


def delayed_shows(forecasts: DataFrame, first: int = 2) -> DataFrame:
    """Of every (stream_id, now, predicted array) the ``first`` predicted beats that lie in the future: index from 0, show_at and delay."""
    each = forecasts.select("stream_id", "now", F.posexplode(F.slice("predicted", 1, first)).alias("index", "show_at"))
    return each.withColumn("delay", F.col("show_at") - F.col("now")).where("delay > 0")


def keep_latest(rows: DataFrame, keys: list[str], trigger: str, at: str) -> DataFrame:
    """The newest row (by ``at``) of every key and trigger: a queue of one that is drained before each put."""
    columns = [c for c in rows.columns if c not in (*keys, trigger)]
    return rows.groupBy(*keys, trigger).agg(F.max_by(F.struct(*columns), F.col(at)).alias("_row")).select(*keys, trigger, "_row.*")


def bounded(rows: DataFrame, keys: list[str], order: str, capacity: int, drop: str = "newest") -> DataFrame:
    """Rows that a full queue of ``capacity`` leaves of every key: the first ones if it drops the newest, else the last ones."""
    if drop not in ("newest", "oldest") or capacity < 1:
        raise ValueError("drop must be newest or oldest, capacity at least 1")
    by = Window.partitionBy(*keys).orderBy(F.col(order).asc() if drop == "newest" else F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= capacity).drop("_n")


def relative_time(unix_time: Column, microseconds: Column, delay: Column) -> tuple[Column, Column]:
    """Unix time (s, us) of ``delay`` seconds after a time (s, us)."""
    return S.unix_split(unix_time, microseconds, delay)


def _events(spark: SparkSession, base: float, n: int, step: float, first_id: int, rgb: list[Column]) -> DataFrame:
    i = F.col("i")
    sec, us = S.unix_split(F.lit(int(base)), F.lit(round((base - int(base)) * 1_000_000)), i * step)
    rows = spark.range(n).withColumnRenamed("id", "i")
    return rows.select((i + first_id).cast("int").alias("event_id"), sec.alias("unix_time"), us.alias("microseconds"), *[c.cast("int").alias(k) for c, k in zip(rgb, "rgb")])


def beat_pattern(spark: SparkSession, base: float, beats: int = 8, bpm: float = 120.0, first_id: int = 3000) -> DataFrame:
    """Events on the beat from Unix time ``base`` on, red and green in turn."""
    even = (F.col("i") % 2 == 0).cast("int")
    return _events(spark, base, beats, 60.0 / bpm, first_id, [even, 1 - even, F.lit(0)])


def colour_pattern(spark: SparkSession, base: float, step: float = 0.5, first_id: int = 4000) -> DataFrame:
    """One event for each of the seven colours, ``step`` seconds apart."""
    rgb = [F.element_at(F.array(*[F.lit(c[k]) for c in COLOURS]), (F.col("i") + 1).cast("int")) for k in range(3)]
    return _events(spark, base, len(COLOURS), step, first_id, rgb)


def batch_payload(events: DataFrame, batch_id: Column) -> DataFrame:
    """One JSON text {"events": [...], "batch_id": ...} of all events (a batch is one message), in order of event_id."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", F.struct("unix_time", "microseconds", "r", "g", "b", "event_id").alias("e"))))
    return events.agg(F.transform(rows, lambda x: x["e"]).alias("events")).select(F.to_json(F.struct("events", batch_id.alias("batch_id"))).alias("payload"))


def time_sync_payload(unix_time: Column, microseconds: Column, source: str = "host") -> Column:
    """JSON text of a time-synchronisation message."""
    return F.to_json(F.struct(unix_time.alias("unix_time"), microseconds.alias("microseconds"), F.lit(source).alias("sync_source")))


def last_sync(messages: DataFrame) -> DataFrame:
    """The newest time message (by ``received_us``) of every device: clock state is the last value."""
    return messages.groupBy("device_id").agg(F.max("received_us").alias("received_us"), F.max_by("unix_time", "received_us").alias("unix_time"), F.max_by("microseconds", "received_us").alias("microseconds"))
