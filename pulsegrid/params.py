"""Frozen parameters of the operators; ranges and choices are checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, fields

INSTRUMENTS = ("kick", "snare", "clap", "chat", "ohc")
ODF_METHODS = ("hfc", "complex", "complex_phase", "flux", "melflux", "rms")


def _check(obj, **ranges) -> None:
    for name, (low, high) in ranges.items():
        value = getattr(obj, name)
        if not low <= value <= high:
            raise ValueError(f"{type(obj).__name__}.{name} must be in [{low}, {high}], not {value}")


def _choice(obj, name: str, values) -> None:
    if getattr(obj, name) not in values:
        raise ValueError(f"{type(obj).__name__}.{name} must be one of {', '.join(values)}")


@dataclass(frozen=True)
class OnsetParams:
    """``sensitivity`` is accepted and has no effect."""

    method: str = "hfc"
    threshold: float = 0.3
    refractory: int = 6
    warmup: int = 10
    sensitivity: float = 1.0
    smooth_window: int = 3
    odf_window: int = 64
    compat: str = "reference"

    def __post_init__(self):
        _choice(self, "method", ODF_METHODS)
        _choice(self, "compat", ("reference", "textbook"))
        _check(self, threshold=(0, 1e9), refractory=(0, 1e9), warmup=(0, 1e9), smooth_window=(1, 1e6), odf_window=(1, 1e6))


@dataclass(frozen=True)
class OnsetVectorParams(OnsetParams):
    threshold: float = 1.0


@dataclass(frozen=True)
class MultiFrameParams:
    window_size: int = 10
    peak_threshold: float = 2.5
    trend_threshold: float = 1.5
    variance_threshold: float = 2.0
    refractory: int = 8
    warmup: int = 20
    detection_mode: str = "combined"

    def __post_init__(self):
        _check(self, window_size=(1, 1e6), refractory=(0, 1e9), warmup=(0, 1e9))


@dataclass(frozen=True)
class QuantileParams:
    q_hi: float = 0.98
    q_lo: float = 0.80
    refractory: int = 4
    warmup: int = 100
    compat: str = "reference"

    def __post_init__(self):
        _check(self, q_hi=(0, 1), q_lo=(0, 1), refractory=(0, 1e9), warmup=(0, 1e9))
        _choice(self, "compat", ("reference", "textbook"))


@dataclass(frozen=True)
class PredictorParams:
    sample_rate: float = 44100.0
    hop_size: int = 256
    warmup_hits: int = 8
    min_bpm: float = 60.0
    max_bpm: float = 200.0
    horizon_seconds: float = 2.0
    max_predictions: int = 2
    confidence_min: float = 0.3
    periodic_interval: float = 0.15
    q_period: float = 1e-6
    q_phase: float = 1e-8
    r_base: float = 1e-4
    decay: float = 0.1

    def __post_init__(self):
        if self.min_bpm <= 0 or self.max_bpm < self.min_bpm or self.hop_size < 1 or self.sample_rate <= 0:
            raise ValueError("tempo, hop or sample rate out of range")


@dataclass(frozen=True)
class LightingParams:
    confidence_threshold: float = 0.3
    min_latency: float = 0.07
    max_latency: float = 2.0
    duplicate_window: float = 0.1
    emit_instruments: tuple[str, ...] = ("kick",)

    def __post_init__(self):
        _check(self, confidence_threshold=(0, 1), duplicate_window=(0.01, 1e9))


@dataclass(frozen=True)
class BeatParams:
    init_period: float = 0.5
    q_phase: float = 1e-4
    q_period: float = 5e-5
    r_meas: float = 2.5e-3


@dataclass(frozen=True)
class MaskParams:
    sample_rate: float = 44100.0
    nyquist: float = 0.0
    expected_bands: int = 64
    lobe_rolloff: float = 0.15


@dataclass(frozen=True)
class BufferParams:
    buffer_size: int = 10
    threshold: float = 0.0
    threshold_mode: str = "always"

    def __post_init__(self):
        _choice(self, "threshold_mode", ("always", "above", "below"))
        _check(self, buffer_size=(1, 1e9))


@dataclass(frozen=True)
class QueueParams:
    capacity: int = 50
    flash_us: int = 150_000


def describe(params) -> dict:
    """Names and values of a parameter object."""
    return {f.name: getattr(params, f.name) for f in fields(params)}


@dataclass(frozen=True)
class NoParams:
    """Operators without parameters."""


@dataclass(frozen=True)
class CutterParams:
    """``chunk_size``: samples of every chunk but a stream's last, if they are all alike; 0 if not."""

    frame_size: int = 1024
    hop_size: int = 256
    sample_rate: float = 44100.0
    silent_frames: str = "keep"
    pad: bool = False
    seed: int = 0
    chunk_size: int = 0

    def __post_init__(self):
        _check(self, frame_size=(1, 1e9), hop_size=(1, 1e9), sample_rate=(1e-9, 1e9))
        _choice(self, "silent_frames", ("keep", "drop", "noise"))


@dataclass(frozen=True)
class MelParams:
    bands: int = 64
    sample_rate: float = 44100.0
    coefficients: int = 13

    def __post_init__(self):
        _check(self, bands=(1, 1e6), sample_rate=(1e-9, 1e9), coefficients=(1, 1e6))


@dataclass(frozen=True)
class RangeParams:
    low: int = 0
    high: int = 0


@dataclass(frozen=True)
class IndexParams:
    index: int = 0
