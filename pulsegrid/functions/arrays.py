"""Column functions over vectors (ARRAY<DOUBLE>)."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import MaskParams

#: Fixed values: (low Hz, high Hz, weight) of each instrument's lobes.
LOBES = {
    "kick": ((40.0, 75.0, 0.75),),
    "snare": ((180.0, 280.0, 0.35), (350.0, 600.0, 0.10), (2000.0, 5000.0, 0.35), (6000.0, 10000.0, 0.20)),
    "clap": ((800.0, 1600.0, 0.30), (2000.0, 6000.0, 0.50), (6000.0, 10000.0, 0.20)),
    "chat": ((3000.0, 6000.0, 0.25), (7000.0, 12000.0, 0.55), (12000.0, 16000.0, 0.20)),
    "ohc": ((3000.0, 6000.0, 0.25), (6000.0, 12000.0, 0.50), (12000.0, 16000.0, 0.25)),
}


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def vector_index(v: Column, index: int) -> Column:
    """Element; a negative index counts as 0; 0.0 outside the vector."""
    return F.coalesce(F.get(v, F.lit(max(0, index))).cast("double"), F.lit(0.0))


def sum_range(v: Column, low: int, high: int) -> Column:
    """Sum of elements low..high inclusive, cut to the vector; 0 where empty."""
    low = max(0, low)
    n = F.greatest(F.lit(0), F.least(F.lit(high), F.size(v) - 1) - F.lit(low) + 1)
    return total(F.slice(v, F.lit(low + 1), n))


def dot(v: Column, weights: list[float]) -> Column:
    return total(F.zip_with(v, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w))


def pack5(*columns: Column) -> Column:
    """Five scalars as a vector, missing ones 0."""
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def median_of(v: Column) -> Column:
    """Middle of the sorted values (without nulls), mean of the two middle ones if even; null of an empty array."""
    return bound(F.sort_array(v), _middle)


def mad_of(v: Column, centre: Column | None = None) -> Column:
    """Median absolute deviation, unscaled."""
    return bound(median_of(v) if centre is None else centre, lambda c: median_of(F.transform(v, lambda x: F.abs(x - c))))


def hit_ratio(values: Column, at_least: float = 0.5, strict: bool = True) -> Column:
    """(hits, n, percentage) of a message; an empty one gives 0 %."""
    hits = F.size(F.filter(values, (lambda x: x > at_least) if strict else (lambda x: x >= at_least)))
    n = F.size(values)
    return F.struct(hits.alias("hits"), n.alias("n"), F.when(n > 0, hits * 100.0 / n).otherwise(0.0).alias("percentage"))


def any_hit(v: Column, at_least: float = 0.5) -> Column:
    """Whether any value reaches ``at_least``."""
    return F.coalesce(F.exists(v, lambda x: x >= at_least), F.lit(False))


def mel_centres(bands: int, nyquist: float) -> np.ndarray:
    top = 2595 * np.log10(1 + nyquist / 700)
    return 700 * (10 ** ((np.arange(bands) + 0.5) * top / bands / 2595) - 1)


@lru_cache(maxsize=32)
def masks(params: MaskParams = MaskParams()) -> dict[str, tuple[float, ...]]:
    """Weights of every instrument over mel bands: raised-cosine lobes, normalised to sum 1."""
    f = mel_centres(params.expected_bands, params.nyquist or params.sample_rate / 2)
    out = {}
    for name, lobes in LOBES.items():
        w = np.zeros(len(f))
        for low, high, weight in lobes:
            edge = min(max((high - low) * params.lobe_rolloff, 0), 0.49 * (high - low))
            shape = np.ones(len(f))
            if edge > 0:
                rise, fall = f < low + edge, f > high - edge
                shape[rise] = 0.5 * (1 - np.cos(np.pi * (f[rise] - low) / edge))
                shape[fall] = 0.5 * (1 - np.cos(np.pi * (high - f[fall]) / edge))
            w += np.where((f >= low) & (f <= high), weight * shape, 0)
        out[name] = tuple(w / w.sum() if w.sum() > 0 else w)
    return out


def instrument_sum(bands: Column, params: MaskParams = MaskParams()) -> Column:
    """Five energies; an empty vector gives an empty one."""
    sums = F.array(*[dot(bands, list(w)) for w in masks(params).values()])
    return F.when(F.size(bands) > 0, sums).otherwise(F.array().cast("array<double>"))
