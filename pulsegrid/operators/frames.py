"""Overlapping frames of a stream of sample chunks, across the borders of chunks of any sizes.

A stream's samples are dealt by position into tiles of ``frames_per_tile`` frames; a chunk goes to each tile that needs some of it,
so neighbouring tiles share frame_size - hop_size samples at most. A tile is one task's work at a time and of bounded size, and one
long stream is as many tiles as it takes. A stream of chunks keeps the samples that later frames need as state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import CutterParams

#: Mean power below which a frame is silent, and the noise that takes its place.
SILENT_POWER, NOISE_LEVEL = 1e-10, 1e-5
#: Multiplier and modulus of the hash that numbers noise samples by their place.
NOISE_FACTOR, NOISE_MODULUS = 48271, 2147483647
#: Chunks whose lengths one window adds up.
BLOCK = 4096
FRAME = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("frame_idx", T.LongType()), T.StructField("frame", T.ArrayType(T.DoubleType()))])


def placed(chunks: DataFrame, chunk_size: int = 0) -> DataFrame:
    """``chunks`` (stream_id, chunk_idx, samples) with ``start``: the place of each chunk's first sample in its stream.

    Where chunks have one size that is their number times it. Else lengths are added up block by block of chunks, then within a
    block, so no task sees all chunks of a long stream; that reads the chunks twice.
    """
    if chunk_size:
        return chunks.select("stream_id", "chunk_idx", "samples", (F.col("chunk_idx") * chunk_size).cast("long").alias("start"))
    sized = chunks.select("stream_id", "chunk_idx", "samples", F.coalesce(F.size("samples"), F.lit(0)).cast("long").alias("_n"), F.floor(F.col("chunk_idx") / BLOCK).cast("long").alias("_block"))
    blocks = sized.groupBy("stream_id", "_block").agg(F.sum("_n").alias("_sum"))
    before = blocks.select("stream_id", "_block", (F.sum("_sum").over(Window.partitionBy("stream_id").orderBy("_block")) - F.col("_sum")).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("stream_id", "_block").orderBy("chunk_idx")) - F.col("_n")
    return sized.withColumn("_within", within).join(before, ["stream_id", "_block"]).select("stream_id", "chunk_idx", "samples", (F.col("_before") + F.col("_within")).alias("start"))


def noise(stream: Column, place: Column, seed: int = 0) -> Column:
    """A number in [-1, 1) by stream, place and seed alone: the same however a stream is cut."""
    k = F.pmod(F.pmod(place, F.lit(NOISE_MODULUS)) * NOISE_FACTOR + F.pmod(stream, F.lit(NOISE_MODULUS)) * 16807 + F.lit(seed), F.lit(NOISE_MODULUS))
    k = F.pmod(k * NOISE_FACTOR, F.lit(NOISE_MODULUS))
    return k / (NOISE_MODULUS / 2.0) - 1.0


def with_noise(frames: DataFrame, hop_size: int, seed: int = 0) -> DataFrame:
    """Frames (stream_id, frame_idx, frame) of a mean power below SILENT_POWER with noise added to their samples."""
    power = F.aggregate("frame", F.lit(0.0), lambda a, x: a + x * x) / F.size("frame")
    noisy = F.transform("frame", lambda x, i: x + NOISE_LEVEL * noise(F.col("stream_id"), F.col("frame_idx") * hop_size + i, seed))
    return frames.withColumn("frame", F.when(power < SILENT_POWER, noisy).otherwise(F.col("frame")))


def silent_handled(frames: DataFrame, params: CutterParams) -> DataFrame:
    if params.silent_frames == "drop":
        return frames.where(F.exists("frame", lambda x: x != 0))
    return with_noise(frames, params.hop_size, params.seed) if params.silent_frames == "noise" else frames


def chunk_frames(chunks: DataFrame, params: CutterParams | None = None, frames_per_tile: int = 256) -> DataFrame:
    """stream_id, frame_idx, frame: frame k holds samples k * hop to k * hop + size of its stream, whatever chunks they came in.

    Null and empty chunks have no samples, null samples count as 0. Samples behind the last whole frame are left out, or with
    ``pad`` fill a last frame with zeros behind them: every frame that begins within the stream is given then. ``silent_frames``:
    keep silent frames, drop those of zeros only, or add a quiet ``noise``.
    """
    p = params or CutterParams()
    size, hop = p.frame_size, p.hop_size
    span = hop * frames_per_tile
    rows = placed(chunks, p.chunk_size).where(F.size("samples") > 0)
    end = F.col("start") + F.size("samples")
    # Tiles whose samples [tile * span, tile * span + span - hop + size) meet the chunk's.
    reach = span - hop + size
    first = F.greatest(F.lit(0), F.floor((F.col("start") - reach) / span) + 1)
    last = F.floor((end - 1) / span)
    tiles = rows.select("stream_id", "start", "samples", F.explode(F.sequence(first, last)).alias("tile"))
    lo, hi = F.col("tile") * span, F.col("tile") * span + reach
    cut = F.slice("samples", (F.greatest(F.lit(0), lo - F.col("start")) + 1).cast("int"), F.greatest(F.lit(0), F.least(end, hi) - F.greatest("start", lo)).cast("int"))
    parts = tiles.select("stream_id", "tile", F.struct(F.greatest("start", lo).alias("at"), cut.alias("v")).alias("part"))
    joined = parts.groupBy("stream_id", "tile").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["v"])).alias("v"))
    v = F.transform("v", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    whole = F.greatest(F.lit(0), F.floor((F.size("v") - size) / hop) + 1)
    begun = F.least(F.lit(frames_per_tile), F.ceil(F.size("v") / hop))
    count = (begun if p.pad else F.least(F.lit(frames_per_tile), whole)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def frame(k: Column) -> Column:
        part = F.slice("v", k * hop + 1, size)
        return F.concat(part, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - F.size(part)))) if p.pad else part

    tiled = joined.select("stream_id", "tile", v.alias("v"))
    each = tiled.select("stream_id", "tile", "v", F.explode(starts).alias("k"))
    frames = each.select("stream_id", (F.col("tile") * frames_per_tile + F.col("k")).cast("long").alias("frame_idx"), frame(F.col("k")).alias("frame"))
    return silent_handled(frames, p)


class FrameCutter:
    """Frames of one stream chunk by chunk: keeps the samples that frames still to come need."""

    def __init__(self, params: CutterParams):
        self.p, self.tail, self.at, self.next = params, np.zeros(0), 0, 0

    def process(self, rows: pd.DataFrame) -> pd.DataFrame:
        size, hop = self.p.frame_size, self.p.hop_size
        new = [np.asarray([0.0 if v is None else v for v in x], float) for x in rows["samples"] if x is not None]
        joined = np.concatenate([self.tail, *new])
        frames, first = [], self.next * hop - self.at
        while first >= 0 and first + size <= len(joined):
            frames.append((rows["stream_id"].iloc[0], self.next, joined[first : first + size].tolist()))
            self.next += 1
            first += hop
        keep = min(max(first, 0), len(joined))
        self.tail, self.at = joined[keep:], self.at + keep
        return pd.DataFrame(frames, columns=FRAME.names)


def frame_stream(chunks: DataFrame, params: CutterParams | None = None) -> DataFrame:
    """``chunk_frames`` of a streaming DataFrame, whose chunks may come late or twice; a stream has no last frame to pad."""
    from ..streaming.stateful import stateful

    p = params or CutterParams()
    rows = chunks.select("stream_id", F.col("chunk_idx").alias("frame_idx"), "samples")
    return silent_handled(stateful(rows, lambda: FrameCutter(p), FRAME), p)

