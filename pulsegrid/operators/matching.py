"""One-to-one matches of predictions and hits within a tolerance, in order of time."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import ordered_scan

MATCH = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("instrument", T.StringType()), T.StructField("t_pred", T.DoubleType()), T.StructField("t_hit", T.DoubleType()), T.StructField("frame_idx", T.LongType()), T.StructField("hit_index", T.IntegerType())])
_HIT, _PREDICTION = 0, 1


class Sweep:
    """Walks hits and predictions of one key by time and pairs each with the earliest open one of the other kind.

    All intervals have one length, so nothing open of one kind can wait while something of the other does, and taking the
    earliest gives as many pairs as any assignment within the tolerance. Only what is open is kept: at most what came
    within one tolerance.
    """

    def __init__(self, tolerance: float):
        self.tolerance, self.open, self.kind = tolerance, deque(), _HIT
        self.key = None

    def _row(self, prediction: tuple | None, hit: float | None) -> tuple:
        t, frame, index = prediction or (None, None, None)
        return (*self.key, t, hit, frame, index)

    def _expired(self, item) -> tuple:
        return self._row(None, item) if self.kind == _HIT else self._row(item, None)

    def scan(self, rows: dict[str, np.ndarray]) -> dict[str, list] | None:
        out = []
        stream, instrument = rows["stream_id"][0], rows["instrument"][0]
        self.key = (None if stream != stream else int(stream), instrument)
        at = lambda item: item if self.kind == _HIT else item[0]
        for t, kind, frame, index in zip(rows["at"].tolist(), rows["kind"].tolist(), rows["frame_idx"].tolist(), rows["hit_index"].tolist()):
            while self.open and t - at(self.open[0]) > self.tolerance:
                out.append(self._expired(self.open.popleft()))
            item = t if kind == _HIT else (t, int(frame), int(index))
            if self.open and self.kind != kind:
                other = self.open.popleft()
                out.append(self._row(other, t) if kind == _HIT else self._row(item, other))
            else:
                self.kind = kind
                self.open.append(item)
        return self._columns(out)

    def ends(self) -> dict[str, list] | None:
        return self._columns([self._expired(item) for item in self.open])

    @staticmethod
    def _columns(rows: list) -> dict[str, list] | None:
        return dict(zip(MATCH.names, map(list, zip(*rows)))) if rows else None


def matches(predictions: DataFrame, hits: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """stream_id, instrument, t_pred, t_hit, frame_idx, hit_index: every prediction and every hit once, alone (the other time is null)
    or in a pair at most ``tolerance`` apart. At one moment hits come first, predictions by frame_idx and hit_index. Rows without a
    time are left out.

    Streams and instruments are sorted once and read once; a key is one task at a time.
    """
    key = ["stream_id", "instrument"]
    none = lambda kind: F.lit(None).cast(kind)
    h = hits.select(*key, F.col("t").alias("at"), F.lit(_HIT).alias("kind"), none("long").alias("frame_idx"), none("int").alias("hit_index"))
    p = predictions.select(*key, F.col("t_pred_sec").alias("at"), F.lit(_PREDICTION).alias("kind"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("hit_index").cast("int").alias("hit_index"))
    return ordered_scan(h.unionByName(p).where("at is not null"), key, ["at", "kind", "frame_idx", "hit_index"], lambda: Sweep(tolerance), MATCH)


def match_report(matched: DataFrame) -> DataFrame:
    """Predictions, hits, pairs, precision, recall, f1 and mean and mean absolute error (hit minus prediction) of each stream and instrument."""
    both = F.col("t_pred").isNotNull() & F.col("t_hit").isNotNull()
    error = F.when(both, F.col("t_hit") - F.col("t_pred"))
    n = matched.groupBy("stream_id", "instrument").agg(F.count("t_pred").alias("n_predictions"), F.count("t_hit").alias("n_hits"), F.count(F.when(both, 1)).alias("n_pairs"), F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mean_abs_error"))
    share = lambda of: F.when(F.col(of) > 0, F.col("n_pairs") / F.col(of))
    f1 = F.when(F.col("n_predictions") + F.col("n_hits") > 0, 2 * F.col("n_pairs") / (F.col("n_predictions") + F.col("n_hits")))
    return n.select("stream_id", "instrument", "n_predictions", "n_hits", "n_pairs", share("n_predictions").alias("precision"), share("n_hits").alias("recall"), f1.alias("f1"), "mean_error", "mean_abs_error")
