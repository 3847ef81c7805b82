"""Ordered scans: one state machine for batch partitions and for streaming state.

A machine has ``process(columns) -> columns`` over rows in order and keeps its own state, so a long
stream is read batch by batch in bounded memory. In a batch, a window numbers each stream's rows, so
streams are shuffled once, or not at all where they already lie together; a task walks its partition
and starts a new machine at each first row. In a stream, the machine itself is the state of its key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_key(machine, rows: pd.DataFrame, outputs: list[str]) -> pd.DataFrame:
    made = machine.process(rows)
    return made if isinstance(made, pd.DataFrame) else rows.assign(**made)[outputs]


def _joined(parts: list, name: str, schema: T.StructType) -> pd.Series:
    """One column of the parts that a batch's keys made; a None in a list of whole numbers stays a null."""
    if len(parts) == 1 or all(isinstance(p, np.ndarray) for p in parts):
        values = parts[0] if len(parts) == 1 else np.concatenate(parts)
    else:
        values = [v for p in parts for v in (p.tolist() if isinstance(p, np.ndarray) else p)]
    if isinstance(values, np.ndarray):
        return pd.Series(values)
    kind = {T.LongType(): "Int64", T.IntegerType(): "Int32", T.DoubleType(): "float64"}.get(schema[name].dataType, object)
    return pd.Series(values, dtype=kind)


def _light(batches: Iterator[pd.DataFrame], make: Callable[[], object], schema: T.StructType) -> Iterator[pd.DataFrame]:
    """The walk for machines with ``scan`` and ``ends``: keys get slices of a batch's arrays and give columns, from which one table a
    batch is made, so that a key costs no table of its own."""
    outputs, machine = schema.names, None
    for batch in batches:
        if not len(batch):
            continue
        starts = np.flatnonzero(batch.pop("_nth").to_numpy() == 1).tolist()
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        first = set(starts)
        cuts = sorted({0, *starts, len(batch)})
        made = []
        for a, b in zip(cuts, cuts[1:]):
            if a in first:
                if machine is not None:
                    made.append(machine.ends())
                machine = make()
            made.append(machine.scan({c: v[a:b] for c, v in columns.items()}))
        made = [m for m in made if m is not None]
        if made:
            yield pd.DataFrame({c: _joined([m[c] for m in made], c, schema) for c in outputs})
    rest = machine.ends() if machine is not None else None
    if rest is not None:
        yield pd.DataFrame({c: _joined([rest[c]], c, schema) for c in outputs})


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], object], schema: T.StructType) -> DataFrame:
    """Run one machine for each key over its rows in order; ``schema`` names the output's columns, of which
    those that the machine doesn't make come from the input. Machines for many short keys have ``scan`` (arrays of a key's rows to
    columns or None) and ``ends`` (columns or None) and make all columns themselves."""
    outputs = schema.names
    light = hasattr(make(), "scan")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if light:
            yield from _light(batches, make, schema)
            return
        machine = None
        for batch in batches:
            if not len(batch):
                continue
            starts = set(np.flatnonzero(batch.pop("_nth").to_numpy() == 1).tolist())
            cuts = sorted({0, *starts, len(batch)})
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                if a in starts:
                    if machine is not None and hasattr(machine, "finish"):
                        parts.append(machine.finish())
                    machine = make()
                parts.append(run_key(machine, batch.iloc[a:b].reset_index(drop=True), outputs))
            out = pd.concat([p for p in parts if p is not None and len(p)] or [pd.DataFrame(columns=outputs)])
            yield out[outputs]
        if machine is not None and hasattr(machine, "finish"):
            rest = machine.finish()
            if rest is not None and len(rest):
                yield rest[outputs]

    dealt = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return dealt.mapInPandas(run, schema)


class Tail:
    """The last values of a series, for windows that reach back over a batch's start."""

    def __init__(self, size: int):
        self.size, self.values = size, np.zeros(0)

    def extend(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Remembered values followed by ``x``, and how many are remembered."""
        joined, before = np.concatenate((self.values, x)), len(self.values)
        self.values = joined[-self.size :] if self.size else joined[:0]
        return joined, before


def _windows(values: np.ndarray, size: int) -> np.ndarray:
    """All windows of ``size`` values as a view; numpy's own sliding_window_view costs more than a short segment's whole work."""
    values = np.ascontiguousarray(values)
    return np.ndarray((len(values) - size + 1, size), values.dtype, values, 0, values.strides * 2)


def trailing(joined: np.ndarray, before: int, size: int, fn: Callable[[np.ndarray], np.ndarray], short: Callable[[np.ndarray], float]) -> np.ndarray:
    """fn over the windows of ``size`` values that end at each new value; short(values) where fewer exist."""
    n = len(joined) - before
    out = np.empty(n)
    first = max(0, size - 1 - before)
    for i in range(min(first, n)):
        out[i] = short(joined[: before + i + 1])
    if n > first:
        view = _windows(joined[before + first - size + 1 :], size)
        out[first:] = fn(view)
    return out


def sliding_mean(joined: np.ndarray, before: int, size: int) -> np.ndarray:
    return trailing(joined, before, size, lambda v: v.sum(1) / size, lambda v: float(v.sum()) / len(v))


def _row_medians(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Median of the ``counts`` smallest values of each row; what pads a row is infinite."""
    ordered, at = np.sort(rows, axis=1), np.arange(len(rows))
    return (ordered[at, (counts - 1) // 2] + ordered[at, counts // 2]) / 2


def trailing_medians(joined: np.ndarray, before: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, median absolute deviation and number of the last ``size`` values (fewer at the start) at each new value."""
    n = len(joined) - before
    counts = np.minimum(np.arange(before + 1, len(joined) + 1), size)
    padded = np.concatenate((np.full(size - 1, np.inf), joined))
    view = _windows(padded, size)[before:]
    m, mad = np.empty(n), np.empty(n)
    step = max(1, (1 << 20) // size)
    for at in range(0, n, step):
        rows, k = view[at : at + step], counts[at : at + step]
        m[at : at + step] = _row_medians(rows, k)
        mad[at : at + step] = _row_medians(np.abs(rows - m[at : at + step, None]), k)
    return m, mad, counts
