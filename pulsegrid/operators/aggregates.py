"""Aggregates over frames, messages and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import BufferParams
from .moments import covariance, inverse_covariance
from .quantiles import running_quantiles

__all__ = ["accuracy", "buffered_messages", "covariance", "frame_arrays", "inverse_covariance", "passes", "pool_stats", "run_summary", "running_median_mad", "running_quantiles", "silence_gate", "trailing_counts", "trailing_rate", "trajectory"]


def pool_stats(values: DataFrame) -> DataFrame:
    """n, mean, var (population), var_samp, min and max of every (stream_id, feature)."""
    return values.groupBy("stream_id", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.var_samp("value").alias("var_samp"), F.min("value").alias("min"), F.max("value").alias("max"))


def frame_arrays(values: DataFrame) -> DataFrame:
    """All values of every (stream_id, feature) in frame order."""
    rows = F.array_sort(F.collect_list(F.struct("frame_idx", "value")))
    return values.groupBy("stream_id", "feature").agg(F.transform(rows, lambda r: r["value"]).alias("frames"))


def running_median_mad(frames: DataFrame, window: int = 64) -> DataFrame:
    """median and raw MAD of the last ``window`` x of every frame."""
    from ..functions.arrays import mad_of

    by = Window.partitionBy("stream_id").orderBy("frame_idx").rowsBetween(-(window - 1), 0)
    rows = frames.select("stream_id", "frame_idx", F.percentile("x", F.lit(0.5)).over(by).alias("median"), F.collect_list("x").over(by).alias("_w"))
    return rows.select("stream_id", "frame_idx", "median", mad_of(F.col("_w"), F.col("median")).alias("mad"))


def trailing_rate(hits: DataFrame, seconds: int = 10) -> DataFrame:
    """total so far, hits in the last ``seconds`` (lower end excluded) and their rate, for (stream_id, instrument, t_us)."""
    by = Window.partitionBy("stream_id", "instrument").orderBy("t_us")
    recent = F.count(F.lit(1)).over(by.rangeBetween(-(seconds * 1_000_000 - 1), 0))
    total = F.count(F.lit(1)).over(by.rangeBetween(Window.unboundedPreceding, 0))
    return hits.select("stream_id", "instrument", "t_us", total.alias("total"), recent.alias("recent"), (recent / seconds).alias("rate"))


def trailing_counts(events: DataFrame, seconds: int = 10) -> DataFrame:
    """total so far, recent (of the last ``seconds``, lower end excluded) and its rate at every row of (stream_id, instrument, t_us, n), where
    a row stands for n hits or predictions; rows of one moment see each other."""
    by = Window.partitionBy("stream_id", "instrument").orderBy("t_us")
    recent = F.sum("n").over(by.rangeBetween(-(seconds * 1_000_000 - 1), 0))
    total = F.sum("n").over(by.rangeBetween(Window.unboundedPreceding, 0))
    return events.select("stream_id", "instrument", "t_us", total.cast("long").alias("total"), recent.cast("long").alias("recent"), (recent / seconds).alias("rate"))


def passes(x: Column, params: BufferParams) -> Column:
    """Whether a value passes the threshold in the mode of ``params``."""
    return {"always": F.lit(True), "above": x >= params.threshold, "below": x <= params.threshold}[params.threshold_mode]


def buffered_messages(frames: DataFrame, feature: str, params: BufferParams = BufferParams()) -> DataFrame:
    """One message for every ``buffer_size`` values that pass: values in order, and the number of frames seen at the
    last one. A trailing incomplete buffer isn't sent."""
    seen = Window.partitionBy("stream_id").orderBy("frame_idx")
    kept = frames.select("stream_id", "frame_idx", "x", F.row_number().over(seen).cast("long").alias("seen")).where(passes(F.col("x"), params))
    grouped = kept.withColumn("message_no", ((F.row_number().over(seen) - 1) / params.buffer_size).cast("long"))
    rows = grouped.groupBy("stream_id", "message_no").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))).alias("v"), F.max("seen").alias("frame_count"))
    return rows.where(F.size("v") == params.buffer_size).select("stream_id", "message_no", F.lit(feature).alias("feature_name"), "frame_count", F.transform("v", lambda r: r["x"]).alias("values"))


def run_summary(frames: DataFrame) -> DataFrame:
    """Duration in seconds, frames and frames a second of every stream."""
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return frames.groupBy("stream_id").agg(seconds.alias("seconds"), F.count(F.lit(1)).alias("frames")).withColumn("fps", F.when(F.col("seconds") > 0, F.col("frames") / F.col("seconds")).otherwise(0.0))


def silence_gate(chunks: DataFrame, least: float = 0.001, free: int = 9) -> DataFrame:
    """Chunks louder than ``least`` (RMS), and the first ``free`` ones of each stream whatever they hold."""
    rms = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x) / F.greatest(F.size("samples"), F.lit(1)))
    return chunks.withColumn("rms", rms).where((F.col("rms") > least) | (F.col("chunk_idx") < free))


def accuracy(predictions: DataFrame, hits: DataFrame) -> DataFrame:
    """For every prediction the next hit of its instrument at or after it (as-of by sorted windows, no range join),
    the last one before it, the smaller absolute error, and whether a hit lies in its interval.

    Where an interval holds its prediction, these two hits tell whether it holds any; other predictions enter the sorts twice, for
    the first hit from ci_low on. Both windows only grow: one looks back over ascending, one over descending times, so a key's work is
    linear in its rows once they are sorted.
    """
    key = ["stream_id", "instrument"]
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda at, kind, frame, index, a, b: [*key, F.col(at).alias("at"), F.lit(kind).alias("kind"), frame.cast("long").alias("frame_idx"), index.cast("int").alias("hit_index"), a.cast("double").alias("a"), b.cast("double").alias("b")]
    told = (F.col("frame_idx"), F.col("hit_index"))
    around = lambda lo, t, hi: F.coalesce((lo <= t) & (t <= hi), F.lit(False))
    odd = predictions.where(~around(F.col("ci_low_sec"), F.col("t_pred_sec"), F.col("ci_high_sec")))
    rows = hits.select(*row("t", 1, none("long"), none("int"), none("double"), none("double")))
    rows = rows.unionByName(predictions.select(*row("t_pred_sec", 0, *told, F.col("ci_low_sec"), F.col("ci_high_sec")))).unionByName(odd.select(*row("ci_low_sec", -1, *told, F.col("t_pred_sec"), F.col("ci_high_sec"))))
    sofar = (Window.unboundedPreceding, Window.currentRow)
    hit = F.when(F.col("kind") == 1, F.col("at"))
    after = F.last(hit, ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("kind")).rowsBetween(*sofar))
    before = F.last(hit, ignorenulls=True).over(Window.partitionBy(*key).orderBy("at", "kind").rowsBetween(*sofar))
    seen = rows.select("*", after.alias("next_hit"), before.alias("last_hit")).where("kind <= 0")
    own = F.col("kind") == 0
    within = F.coalesce(F.col("last_hit") >= F.col("a"), F.lit(False)) | F.coalesce(F.col("next_hit") <= F.col("b"), F.lit(False))
    held = F.when(~own, F.col("next_hit") <= F.col("b")).when(around(F.col("a"), F.col("at"), F.col("b")), within)
    merged = seen.groupBy(*key, "frame_idx", "hit_index", F.when(own, F.col("at")).otherwise(F.col("a")).alias("t_pred_sec")).agg(
        F.max(F.when(own, F.col("next_hit"))).alias("next_hit"),
        F.max(F.when(own, F.col("last_hit"))).alias("last_hit"),
        F.coalesce(F.max(held), F.lit(False)).alias("in_interval"),
    )
    error = F.least(F.abs(F.col("next_hit") - F.col("t_pred_sec")), F.abs(F.col("t_pred_sec") - F.col("last_hit")))
    return merged.withColumn("abs_error", F.round(error, 6))


def trajectory(moves: DataFrame, points: int = 60) -> DataFrame:
    """points - 1 rows (step, position, time) of the minimum-jerk move of each (move_id, x0, x1, t0, t1)."""
    from ..functions.scalars import min_jerk

    duration = F.col("t1") - F.col("t0")
    t = duration * F.col("step") / (points - 1)
    rows = moves.select("*", F.explode(F.sequence(F.lit(1), F.lit(points - 1))).alias("step"))
    return rows.select("move_id", "step", min_jerk(F.col("x0"), F.col("x1"), duration, t)["position"].alias("position"), (F.col("t0") + t).alias("time"))
