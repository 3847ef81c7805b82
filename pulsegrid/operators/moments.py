"""Means and centred co-moments that merge pairwise, so no large sums cancel and no result depends on how rows lie in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First merge by as many salts a stream, so that the parts of all tasks never meet in one.
SALTS = 64
PART = "stream_id long, width int, salt int, n long, mean binary, gram binary"


@dataclass
class Moments:
    """Number, mean and sum of products of deviations of vectors of one width."""

    n: int
    mean: np.ndarray
    gram: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(0)
        d = x - mean
        mean = mean + d.mean(0)  # what rounding left of the mean
        d = x - mean
        return Moments(len(x), mean, d.T @ d)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.gram + other.gram + np.outer(d, d) * (self.n * other.n / n))

    def narrowed(self, width: int) -> Moments:
        return Moments(self.n, self.mean[:width], self.gram[:width, :width])

    def packed(self) -> dict:
        return {"n": self.n, "mean": self.mean.tobytes(), "gram": self.gram.tobytes()}

    @staticmethod
    def unpacked(n: int, mean: bytes, gram: bytes) -> Moments:
        m = np.frombuffer(mean)
        return Moments(int(n), m, np.frombuffer(gram).reshape(len(m), len(m)))


def merge_all(parts: list[Moments]) -> Moments:
    """Neighbours first, then pairs of pairs: rounding errors grow with the logarithm of the number of parts."""
    while len(parts) > 1:
        parts = [a.merged(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0]


def of_rows(vectors: pd.Series) -> dict[int, Moments]:
    """Moments of the vectors of each width; null and empty ones are left out."""
    by_width: dict[int, list] = {}
    for v in vectors:
        if v is not None and len(v):
            by_width.setdefault(len(v), []).append(v)
    return {w: Moments.of(np.array(rows, float)) for w, rows in by_width.items()}


def pair_rows(by_width: dict[int, Moments]) -> pd.DataFrame:
    """i, j (i <= j), n and cov of the positions: a pair counts over all rows that hold both."""
    widths, out, sofar = sorted(by_width, reverse=True), [], None
    for k, w in enumerate(widths):
        part = by_width[w]
        # Positions from the next smaller width on are held by what is merged so far alone.
        sofar = part if sofar is None else sofar.narrowed(w).merged(part)
        least = widths[k + 1] if k + 1 < len(widths) else 0
        i, j = np.triu_indices(w)
        mine = j >= least
        i, j = i[mine], j[mine]
        out.append(pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": sofar.n, "cov": sofar.gram[i, j] / sofar.n}))
    return pd.concat(out)


def moment_parts(vectors: DataFrame, column: str) -> DataFrame:
    """One row a stream and width of vectors: their merged moments."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        state: dict = {}
        for batch in batches:
            for stream, part in batch.groupby("stream_id", sort=False, dropna=False)[column]:
                for width, m in of_rows(part).items():
                    key = (None if pd.isna(stream) else stream, width)
                    state[key] = state[key].merged(m) if key in state else m
        salt = TaskContext.get().partitionId() % SALTS
        rows = [{"stream_id": s, "width": w, "salt": salt, **m.packed()} for (s, w), m in state.items()]
        if rows:
            yield pd.DataFrame(rows).astype({"stream_id": "Int64"})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        m = merge_all([Moments.unpacked(*r) for r in rows[["n", "mean", "gram"]].itertuples(index=False)])
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in ("stream_id", "width", "salt")}, **m.packed()}]).astype({"stream_id": "Int64"})

    parts = vectors.select(F.col("stream_id").cast("long").alias("stream_id"), column).mapInPandas(sums, PART)
    for _ in range(2):
        parts = parts.groupBy("stream_id", "width", "salt").applyInPandas(merge, PART).withColumn("salt", F.lit(0))
    return parts


def covariance(vectors: DataFrame, column: str = "bands") -> DataFrame:
    """stream_id, i, j (i <= j), n and population covariance of every pair of positions, over all rows of a stream that hold both.

    Vectors may have any widths; null and empty ones count nowhere. A task merges its rows' moments into one matrix a stream and
    width, tasks' matrices meet in two steps.
    """

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        found = pair_rows({int(r.width): Moments.unpacked(r.n, r.mean, r.gram) for r in rows.itertuples()})
        return found.assign(stream_id=rows["stream_id"].iloc[0])[["stream_id", "i", "j", "n", "cov"]].astype({"stream_id": "Int64"})

    return moment_parts(vectors, column).groupBy("stream_id").applyInPandas(pairs, "stream_id long, i int, j int, n long, cov double")


def inverse_covariance(vectors: DataFrame, column: str = "bands") -> DataFrame:
    """Pseudo-inverse of each stream's covariance, as rows (i, j, icov); the matrix has the widest vector's width.

    Streams of fewer frames than values have a singular covariance; eigenvalues below 1e-10 of the largest are
    rounding errors of its sums and count as 0."""

    def invert(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["j"].max()) + 1
        m = np.zeros((n, n))
        m[rows["i"], rows["j"]] = rows["cov"]
        m[rows["j"], rows["i"]] = rows["cov"]
        inv = np.linalg.pinv(m, rcond=1e-10, hermitian=True)
        i, j = np.indices((n, n)).reshape(2, -1)
        return pd.DataFrame({"stream_id": rows["stream_id"].iloc[0], "i": i, "j": j, "icov": inv.ravel()}).astype({"stream_id": "Int64"})

    return covariance(vectors, column).groupBy("stream_id").applyInPandas(invert, "stream_id long, i int, j int, icov double")


class RunningMoments:
    """Covariance so far as keyed state: merges a micro-batch's moments into those before."""

    def __init__(self):
        self.by_width: dict[int, Moments] = {}

    def add(self, vectors: pd.Series) -> None:
        for w, m in of_rows(vectors).items():
            self.by_width[w] = self.by_width[w].merged(m) if w in self.by_width else m

    def rows(self) -> pd.DataFrame:
        return pair_rows(self.by_width) if self.by_width else pd.DataFrame({"i": [], "j": [], "n": [], "cov": []})
