"""Spectral front end: window, magnitude spectrum, mel bands, cepstrum; numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Four-term Blackman-Harris coefficients.
BLACKMAN_HARRIS_62 = (0.44959, 0.49364, 0.05677, 0.0)

#: Values of a batch that are worked on at a time.
PIECE = 1 << 18


def blackman_harris(n: int) -> np.ndarray:
    k = 2 * np.pi * np.arange(n) / max(1, n - 1)
    a = BLACKMAN_HARRIS_62
    w = a[0] - a[1] * np.cos(k) + a[2] * np.cos(2 * k) - a[3] * np.cos(3 * k)
    return 2 * w / w.sum()


def windowed(frames: DataFrame, size: int) -> DataFrame:
    w = F.array(*[F.lit(float(x)) for x in blackman_harris(size)])
    return frames.withColumn("frame", F.zip_with("frame", w, lambda x, y: x * y))


def mel_filters(bands: int, bins: int, sample_rate: float, top: float | None = None) -> np.ndarray:
    """Triangles of unit area on the mel scale, (bands, bins)."""
    top = top or sample_rate / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), bands + 2) / 2595) - 1)
    f = np.arange(bins) * sample_rate / 2 / (bins - 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))) * 2 / (high - low)


def _matrices(lists: pa.Array, fn: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """``fn`` of the matrices of lists of one length, at most PIECE values at a time; null and empty lists give empty ones."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    begins = np.cumsum(lengths) - lengths
    made: list[tuple[np.ndarray, np.ndarray]] = []
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows, step = np.flatnonzero(lengths == n), max(1, PIECE // n)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            made.append((some, fn(values[begins[some][:, None] + np.arange(n)])))
    sizes = np.zeros(len(lengths), np.int64)
    for some, m in made:
        sizes[some] = m.shape[1]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(offsets[-1])
    for some, m in made:
        out[offsets[some][:, None] + np.arange(m.shape[1])] = m
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))


def _magnitudes(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(x, axis=1))


def _projected(bands: int, sample_rate: float) -> Callable[[np.ndarray], np.ndarray]:
    filters: dict[int, np.ndarray] = {}

    def project(x: np.ndarray) -> np.ndarray:
        if x.shape[1] not in filters:
            filters[x.shape[1]] = mel_filters(bands, x.shape[1], sample_rate)
        return x**2 @ filters[x.shape[1]].T

    return project


def _cosines(n: int) -> Callable[[np.ndarray], np.ndarray]:
    def transform(x: np.ndarray) -> np.ndarray:
        k = x.shape[1]
        basis = np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(k) + 1) / (2 * k)) * np.sqrt(2 / k)
        basis[0] /= np.sqrt(2)
        return 10 * np.log10(np.maximum(1e-10, x)) @ basis.T

    return transform


def _column(fn: Callable[[np.ndarray], np.ndarray], column: str) -> Column:
    @F.arrow_udf("array<double>")
    def made(lists: pa.Array) -> pa.Array:
        return _matrices(lists, fn)

    return made(column)


def spectrum(frames: DataFrame) -> DataFrame:
    """``spectrum``: magnitudes of each ``frame`` (n / 2 + 1 bins); empty frames give an empty one."""
    return frames.withColumn("spectrum", _column(_magnitudes, "frame")).drop("frame")


def mel_bands(spectra: DataFrame, bands: int = 64, sample_rate: float = 44100.0) -> DataFrame:
    """``bands``: energies (squared magnitudes) under each filter."""
    return spectra.withColumn("bands", _column(_projected(bands, sample_rate), "spectrum")).drop("spectrum")


def mfcc(banded: DataFrame, n: int = 13) -> DataFrame:
    """``mfcc``: orthonormal cosine transform of the bands' logarithms in dB."""
    return banded.withColumn("mfcc", _column(_cosines(n), "bands"))


def front(frames: DataFrame, bands: int = 64, sample_rate: float = 44100.0, n: int = 13) -> DataFrame:
    """``spectrum``, ``bands`` and ``mfcc`` of each ``frame`` as the three functions give them, in one Python process a task."""
    project, transform = _projected(bands, sample_rate), _cosines(n)

    @F.arrow_udf("struct<spectrum:array<double>,bands:array<double>,mfcc:array<double>>")
    def made(lists: pa.Array) -> pa.Array:
        spectra = _matrices(lists, _magnitudes)
        banded = _matrices(spectra, project)
        return pa.StructArray.from_arrays([spectra, banded, _matrices(banded, transform)], ["spectrum", "bands", "mfcc"])

    return frames.withColumn("_made", made("frame")).drop("frame").select("*", "_made.*").drop("_made")
