"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import INSTRUMENTS

Any = Column | float | int


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)


def clamp(x: Column, low: Any, high: Any) -> Column:
    return F.greatest(_c(low), F.least(x, _c(high)))


def wrap_unit(x: Column) -> Column:
    """Into [0, 1)."""
    return x - F.floor(x)


def wrap_half(x: Column) -> Column:
    """Into [-0.5, 0.5)."""
    return wrap_unit(x + 0.5) - 0.5


def hann_edge(x: Column) -> Column:
    return 0.5 * (1.0 - F.cos(F.lit(3.141592653589793) * x))


def lobe_weight(f: Column, low: Any, high: Any, weight: Any, rolloff: Any) -> Column:
    """Weight of a frequency in a lobe with raised-cosine edges; zero outside [low, high]."""
    low, high, weight = _c(low), _c(high), _c(weight)
    span = high - low
    edge = clamp(span * _c(rolloff), 0.0, 0.49 * span)
    shape = F.when(f < low + edge, hann_edge((f - low) / edge)).when(f > high - edge, hann_edge((high - f) / edge)).otherwise(F.lit(1.0))
    return F.when((f < low) | (f > high), F.lit(0.0)).otherwise(weight * shape)


def audio_time(frame: Column, hop: int = 256, sample_rate: float = 44100.0) -> Column:
    return frame * F.lit(float(hop)) / F.lit(float(sample_rate))


def round_away(x: Column, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(x, digits)


def event_id(instrument: Column, t: Column) -> Column:
    """``name_12.34``: the time in hundredths."""
    return F.concat(instrument, F.lit("_"), F.format_string("%.2f", round_away(t, 2)))


def unix_split(start_sec: Column, start_us: Column, t: Column) -> tuple[Column, Column]:
    """(seconds, microseconds) of a start and an offset in seconds, carried and borrowed exactly."""
    total = start_us.cast("long") + round_away(t * 1000000.0).cast("long")
    us = F.pmod(total, F.lit(1000000).cast("long"))
    return start_sec.cast("long") + ((total - us) / 1000000).cast("long"), us


def colour(instrument: Column) -> Column:
    """(r, g, b): kick red, snare green, else blue."""
    is_, one = lambda n: (instrument == n).cast("int"), F.lit(1)
    return F.struct(is_("kick").alias("r"), is_("snare").alias("g"), F.when(instrument.isin("kick", "snare"), 0).otherwise(one).alias("b"))


def instrument_name(index: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, INSTRUMENTS)), (index + 1).cast("int"))


def instrument_index(name: Column, default: int | None = None) -> Column:
    """Position of the lower-cased name; unknown names give ``default``."""
    at = F.array_position(F.array(*map(F.lit, INSTRUMENTS)), F.lower(name)) - 1
    return F.when(at >= 0, at).otherwise(F.lit(default)).cast("int")


def feature_index(feature: Column) -> Column:
    """Index of a ``gate.<instrument>`` feature, else null."""
    return F.when(feature.startswith("gate."), instrument_index(F.substring(feature, 6, 100)))


def json_field(doc: Column, name: str, kind: str, default) -> Column:
    return F.coalesce(F.get_json_object(doc, f"$.{name}").try_cast(kind), F.lit(default).cast(kind))


def min_jerk(x0: Column, x1: Column, duration: Column, t: Column) -> Column:
    """(position, velocity, acceleration, jerk) at t on the minimum-jerk path."""
    s, d = t / duration, x1 - x0
    return F.struct(
        (x0 + d * (10 * s * s * s - 15 * s * s * s * s + 6 * s * s * s * s * s)).alias("position"),
        (d / duration * (30 * s * s - 60 * s * s * s + 30 * s * s * s * s)).alias("velocity"),
        (d / (duration * duration) * (60 * s - 180 * s * s + 120 * s * s * s)).alias("acceleration"),
        (d / (duration * duration * duration) * (60 - 360 * s + 360 * s * s)).alias("jerk"),
    )


def beat_forecast(now: Column, phase: Column, period: Column, k: int) -> Column:
    """The next k beats after ``now`` on the grid phase + n * period, n at least 1."""
    first = F.greatest(F.lit(1).cast("long"), F.ceil((now - phase) / period).cast("long"))
    return F.transform(F.sequence(first, first + F.lit(k - 1)), lambda n: phase + n * period)


def tick_us(unix: Column, us: Column, sync_unix: Column, sync_us: Column, sync_tick: Column) -> Column:
    """Device tick of a Unix time, given one tick at a known Unix time; earlier times give smaller ticks."""
    return sync_tick + (unix - sync_unix) * 1000000 + (us - sync_us)


def ntp_offset(server: Column, local: Column) -> Column:
    return server - local


def lane(index: Column, width: int, lanes: int = len(INSTRUMENTS)) -> Column:
    """Left edge of a lane on a canvas of ``width``."""
    return index * F.lit(width // lanes)


def place(index: Column, hit_index: Column, width: int, height: int, layout: str = "horizontal", lanes: int = len(INSTRUMENTS), start: float = 0.35, spacing: float = 0.1) -> Column:
    """Struct (x, y) of a forecast on a canvas: its instrument's lane one way, and from ``start`` on one step of ``spacing`` for
    each hit_index the other way."""
    if layout not in ("horizontal", "vertical"):
        raise ValueError("layout must be horizontal or vertical")
    across, along = (height, width) if layout == "horizontal" else (width, height)
    lane_at = (index + 1) * F.lit(across // (lanes + 1))
    step_at = F.lit(int(along * start)) + (hit_index - 1) * F.lit(int(along * spacing))
    x, y = (step_at, lane_at) if layout == "horizontal" else (lane_at, step_at)
    return F.struct(x.alias("x"), y.alias("y"))


def is_gate(feature: Column, anywhere: bool = False) -> Column:
    """Whether a feature's name begins with ``gate.`` (or holds ``gate`` at all)."""
    return feature.contains("gate") if anywhere else feature.startswith("gate.")


def log_file_name(prefix: str, ts: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(suffix))


def query_flag(url: Column, name: str) -> Column:
    """1 if the query holds ``name=1``."""
    return (F.instr(url, f"{name}=1") > 0).cast("int")


def ms_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)
