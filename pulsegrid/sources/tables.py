"""Tables as ordered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import INSTRUMENTS

#: Which event type stands for which instrument.
EVENT_INSTRUMENT = {"click": "kick", "view": "snare", "signup": "clap", "purchase": "chat", "error": "ohc"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id (user), frame_idx (from 0, by time and id), x, event_type, instrument, ts, event_id, props."""
    events = read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    name = F.create_map(*[F.lit(v) for pair in EVENT_INSTRUMENT.items() for v in pair])[F.col("event_type")]
    return events.select(F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.col("value").alias("x"), "event_type", name.alias("instrument"), "ts", "event_id", "props")


def gate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_frames with ``gates``: 1.0 for the instrument of the event, 0.0 for the others."""
    gates = F.array(*[(F.col("instrument") == n).cast("double") for n in INSTRUMENTS])
    return event_frames(spark, sf_dir).withColumn("gates", gates)


def band_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id (label), frame_idx (from 0, by vec_id), vec_id and bands of the embeddings."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("bands"))


def sine(spark: SparkSession, n: int, hz: float = 440.0, sample_rate: float = 44100.0) -> DataFrame:
    """Samples of a sine."""
    return spark.range(n).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("sample_idx"), F.sin(F.col("id") * (2 * 3.141592653589793 * hz / sample_rate)).alias("sample"))


def cut_frames(chunks: DataFrame, frame_size: int, hop: int, samples: Column | str = "samples", silent: str = "keep", pad: bool = False) -> DataFrame:
    """Overlapping frames of each row's sample array. A last short one is left out, or filled with zeros with ``pad``.

    ``silent`` "drop" leaves out frames of zeros only; the frames kept are numbered as they lie.
    """
    if silent not in ("keep", "drop") or frame_size < 1 or hop < 1:
        raise ValueError("silent must be keep or drop, frame_size and hop positive")
    v = F.col(samples) if isinstance(samples, str) else samples
    zero = F.lit(0).cast("long")
    if pad:
        count = F.ceil(F.size(v) / hop)
        frame = lambda s: F.concat(F.slice(v, (s + 1).cast("int"), frame_size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), frame_size - (F.size(v) - s)).cast("int")))
        some = F.size(v) > 0
    else:
        count = F.floor((F.size(v) - frame_size) / hop) + 1
        frame = lambda s: F.slice(v, (s + 1).cast("int"), frame_size)
        some = F.size(v) >= frame_size
    starts = F.when(some, F.transform(F.sequence(zero, F.greatest(zero, count - 1)), lambda i: i * hop)).otherwise(F.array().cast("array<bigint>"))
    out = chunks.select(*[c for c in chunks.columns if c not in ("samples", "frame")], F.posexplode(F.transform(starts, frame)).alias("frame_idx", "frame")).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    return out if silent == "keep" else out.where(F.exists("frame", lambda x: x != 0))
