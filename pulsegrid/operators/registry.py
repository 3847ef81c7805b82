"""Operators by name, created with named parameters, and chains of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import arrays
from ..sources import messages, tables
from . import aggregates, device, dsp, frames, gates, lighting, tracking


def _cut(df: DataFrame, p: P.CutterParams) -> DataFrame:
    """Frames across numbered chunks of a stream, or of each row's samples alone."""
    if "chunk_idx" in df.columns:
        return frames.chunk_frames(df, p)
    out = tables.cut_frames(df, p.frame_size, p.hop_size, silent="drop" if p.silent_frames == "drop" else "keep", pad=p.pad)
    return frames.with_noise(out, p.hop_size, p.seed) if p.silent_frames == "noise" else out


REGISTRY: dict[str, tuple[type, Callable[..., DataFrame]]] = {
    "HitGateOnset": (P.OnsetParams, gates.onset_gate),
    "HitGateOnsetVector": (P.OnsetVectorParams, gates.onset_gate_vector),
    "HitGateMultiFrame": (P.MultiFrameParams, gates.multiframe_gate),
    "HitGateQuantile": (P.QuantileParams, gates.quantile_gate),
    "InstrumentPredictor": (P.PredictorParams, tracking.instrument_predictor),
    "LightingEngine": (P.LightingParams, lighting.commands),
    "BeatPredictorKF": (P.BeatParams, tracking.beat_kalman),
    "DeviceQueue": (P.QueueParams, device.device_queue),
    "FrameCutter": (P.CutterParams, lambda df, p: _cut(df, p)),
    "Windowing": (P.CutterParams, lambda df, p: dsp.windowed(df, p.frame_size)),
    "Spectrum": (P.NoParams, lambda df, p: dsp.spectrum(df)),
    "MelBands": (P.MelParams, lambda df, p: dsp.mel_bands(df, p.bands, p.sample_rate)),
    "MFCC": (P.MelParams, lambda df, p: dsp.mfcc(df, p.coefficients)),
    "InstrumentSum": (P.MaskParams, lambda df, p: df.withColumn("sums", arrays.instrument_sum(F.col("bands"), p))),
    "SumRange": (P.RangeParams, lambda df, p: df.withColumn("sum", arrays.sum_range(F.col("bands"), p.low, p.high))),
    "VectorIndex": (P.IndexParams, lambda df, p: df.withColumn("value", arrays.vector_index(F.col("bands"), p.index))),
    "VectorPack5": (P.NoParams, lambda df, p: df.withColumn("gates", arrays.pack5(*[F.col(n) for n in P.INSTRUMENTS]))),
    "PoolAggregator": (P.NoParams, lambda df, p: aggregates.pool_stats(df)),
    "BufferedPublisher": (P.BufferParams, lambda df, p: aggregates.buffered_messages(df, "gate", p)),
    "HitLogger": (P.CutterParams, lambda df, p: messages.hit_log(df, p.hop_size, p.sample_rate)),
    "PredictionLogger": (P.NoParams, lambda df, p: messages.prediction_log(df)),
}


def create(name: str, **named) -> Callable[[DataFrame], DataFrame]:
    """A DataFrame function for ``.transform``; unknown names and parameters raise ValueError."""
    if name not in REGISTRY:
        raise ValueError(f"no operator {name!r}")
    kind, fn = REGISTRY[name]
    try:
        made = kind(**named)
    except TypeError as error:
        raise ValueError(str(error)) from error
    return lambda df: fn(df, made)


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


