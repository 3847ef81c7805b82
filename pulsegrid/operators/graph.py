"""Graphs of operators with named ports: what several branches share is planned once, and several sinks read one result.

A node's operator adds its output columns to the rows of its inputs, or makes new rows. Ports that lie on the same rows are columns
of one DataFrame: joining them again is no join, and a chain of such nodes reads its source once. Ports on different rows meet by
stream_id and frame_idx.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..functions import arrays
from ..params import INSTRUMENTS, CutterParams, LightingParams, MaskParams, MelParams, OnsetParams, PredictorParams
from . import dsp, lighting, tracking
from .frames import chunk_frames
from .gates import OnsetGate
from .scan import ordered_scan

ROW = ("stream_id", "frame_idx")


@dataclass(frozen=True)
class Operator:
    """``run(rows, columns, names)``: rows with its output columns, given the columns of its input ports by name and the names that its
    outputs are to have. ``new_rows``: whether its rows are others than its inputs'."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Callable[[DataFrame, dict[str, str], dict[str, str]], DataFrame]
    new_rows: bool = False


def column_operator(inputs: tuple[str, ...], output: str, fn: Callable[..., Column]) -> Operator:
    return Operator(inputs, (output,), lambda df, c, names: df.withColumn(names[output], fn(*[F.col(c[i]) for i in inputs])))


def renaming(inputs: tuple[str, ...], output: str, fn: Callable[[DataFrame], DataFrame], inner: str, made: str) -> Operator:
    """An operator of a DataFrame function that reads column ``inner`` and leaves column ``made``."""

    def run(df: DataFrame, columns: dict[str, str], names: dict[str, str]) -> DataFrame:
        kept = F.struct(*[F.col(c) for c in df.columns if c not in ROW]).alias("_kept")
        out = fn(df.select(*ROW, kept, F.col(columns[inputs[0]]).alias(inner)))
        return out.select(*ROW, "_kept.*", F.col(made).alias(names[output]))

    return Operator(inputs, (output,), run)


class GateBank:
    """Onset gates of the five instruments over one stream of sums, walked together."""

    def __init__(self, params: tuple[OnsetParams, ...]):
        self.gates = [OnsetGate(p) for p in params]

    def process(self, rows: pd.DataFrame) -> dict:
        none = np.zeros(len(self.gates))
        x = np.array([v if v is not None and len(v) == len(self.gates) else none for v in rows["_sums"]], float).reshape(len(rows), len(self.gates))
        hits = np.stack([g.process(pd.DataFrame({"x": x[:, i]}))["hit"] for i, g in enumerate(self.gates)], axis=1)
        return {"_gates": hits.astype(float).tolist()}


def gate_bank(params: tuple[OnsetParams, ...]) -> Operator:
    """``sums`` (five energies a frame) to ``gates`` (five zeros or ones): all gates in one scan of a stream."""

    def run(df: DataFrame, columns: dict[str, str], names: dict[str, str]) -> DataFrame:
        kept = [c for c in df.columns if c not in ROW]
        rows = df.select(*ROW, F.struct(*kept).alias("_kept"), F.col(columns["sums"]).alias("_sums"))
        fields = [f for f in rows.schema.fields if f.name != "_sums"]
        schema = T.StructType([*fields, T.StructField("_gates", T.ArrayType(T.DoubleType()))])
        out = ordered_scan(rows, ["stream_id"], ["frame_idx"], lambda: GateBank(params), schema)
        return out.select(*ROW, "_kept.*", F.col("_gates").alias(names["gates"]))

    return Operator(("sums",), ("gates",), run)


def predictor(params: PredictorParams) -> Operator:
    def run(df, columns, names):
        out = tracking.instrument_predictor(df.select(*ROW, F.col(columns["gates"]).alias("gates")), params)
        return out.select(*ROW, F.col("timestamp_sec").alias(names["time"]), F.col("predictions").alias(names["predictions"]))

    return Operator(("gates",), ("time", "predictions"), run, new_rows=True)


def lighting_engine(params: LightingParams) -> Operator:
    """Commands of the predictions: several rows a frame, numbered by their event's id."""

    def run(df, columns, names):
        each = df.select(*ROW, F.col(columns["time"]).alias("now"), F.explode(columns["predictions"]).alias("p")).select(*ROW, "now", "p.instrument", F.explode("p.hits").alias("h"))
        out = lighting.commands(each.select(*ROW, "now", "instrument", "h.hit_index", "h.t_pred_sec", "h.ci_low_sec", "h.ci_high_sec", "h.confidence"), params)
        return out.select(*ROW, F.struct("instrument", "t_pred_sec", "confidence", "r", "g", "b", "event_id").alias(names["command"]))

    return Operator(("time", "predictions"), ("command",), run, new_rows=True)


def frame_cutter(params: CutterParams) -> Operator:
    def run(df, columns, names):
        chunks = df.select("stream_id", F.col("frame_idx").alias("chunk_idx"), F.col(columns["signal"]).alias("samples"))
        return chunk_frames(chunks, params).withColumnRenamed("frame", names["frame"])

    return Operator(("signal",), ("frame",), run, new_rows=True)


@dataclass
class Graph:
    """``source``: the ports that rows of (stream_id, frame_idx, ...) bring along. Nodes are added in any order."""

    source: tuple[str, ...]
    nodes: dict[str, tuple[Operator, dict[str, str]]] = field(default_factory=dict)

    def add(self, name: str, operator: Operator, **inputs: str) -> Graph:
        """``inputs``: input port = "node.port" or a port of the source."""
        if name in self.nodes or "." in name or name in self.source:
            raise ValueError(f"there is a {name!r} already, or it isn't a name")
        if set(inputs) != set(operator.inputs):
            raise ValueError(f"{name} has inputs {', '.join(operator.inputs)}")
        self.nodes[name] = (operator, inputs)
        return self

    def _ports(self, name: str) -> set[str]:
        return {f"{name}.{o}" for o in self.nodes[name][0].outputs}

    def order(self) -> list[str]:
        """Nodes behind all that they read; unknown ports and circles are errors."""
        known, out, rest = set(self.source), [], dict(self.nodes)
        while rest:
            ready = [n for n, (_, inputs) in rest.items() if set(inputs.values()) <= known]
            if not ready:
                raise ValueError(f"unknown ports or a circle: {', '.join(sorted(rest))}")
            for n in ready:
                del rest[n]
                known |= self._ports(n)
            out += ready
        return out

    def _planned(self, rows: DataFrame, wanted: tuple[str, ...] | None, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[list[DataFrame], dict[str, int]]:
        """Tables of rows, and which of them each port lies on. A table that several sinks or nodes with rows of their own read is handed
        to ``keep`` before the first of them."""
        order = self.order()
        if wanted is not None:
            if unknown := set(wanted) - set(self.source) - {p for n in order for p in self._ports(n)}:
                raise ValueError(f"unknown ports: {', '.join(sorted(unknown))}")
            needed = set(wanted)
            for n in reversed(order):
                if self._ports(n) & needed:
                    needed |= set(self.nodes[n][1].values())
            order = [n for n in order if self._ports(n) & needed]
        lies: dict[str, int] = {p: 0 for p in self.source}
        plan, n_tables, readers = [], 1, []
        for n in order:
            operator, inputs = self.nodes[n]
            at = sorted({lies[p] for p in inputs.values()})
            new = operator.new_rows or len(at) > 1
            to = n_tables if new else at[0]
            n_tables += new
            readers += at if new else []
            lies.update({p: to for p in self._ports(n)})
            plan.append((n, at, to))
        readers += [lies[p] for p in wanted or ()]
        tables: list[DataFrame] = [rows.select(*ROW, *self.source)]
        kept: set[int] = set()
        for i, (n, at, to) in enumerate(plan):
            operator, inputs = self.nodes[n]
            # Only ports that are still to be read go on: a scan would carry frames and spectra through Python else.
            read = {p for m, _, _ in plan[i:] for p in self.nodes[m][1].values()} | set(lies if wanted is None else wanted)
            for k in at:
                if k not in kept:
                    tables[k] = tables[k].select(*ROW, *[c for c in tables[k].columns if c in {_column(p) for p in read}])
            if to == len(tables):
                for k in at:
                    if keep and k not in kept and readers.count(k) > 1:
                        tables[k] = keep(tables[k])
                        kept.add(k)
            base = tables[at[0]]
            if len(at) > 1:  # ports on different rows: only the columns that are read meet
                parts = [tables[k].select(*ROW, *[_column(p) for p in dict.fromkeys(inputs.values()) if lies[p] == k]) for k in at]
                base = parts[0]
                for part in parts[1:]:
                    base = base.join(part, list(ROW))
            made = operator.run(base, {i: _column(p) for i, p in inputs.items()}, {o: f"{n}_{o}" for o in operator.outputs})
            if to == len(tables):
                tables.append(made)
            else:
                tables[to] = made
        for k in set(readers):
            if keep and k not in kept and readers.count(k) > 1:
                tables[k] = keep(tables[k])
        return tables, lies

    def build(self, rows: DataFrame, wanted: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
        """``ROW`` and the port's column (named like the port, dots as underscores) of every wanted port (default: all). Ports on the
        same rows come from the same DataFrame; nodes that no wanted port needs aren't planned."""
        tables, lies = self._planned(rows, wanted)
        return {p: tables[lies[p]].select(*ROW, _column(p)) for p in wanted or lies}

    def run(self, rows: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> None:
        """Hand every sink the rows of its port. What several of them need is kept while they run, so the source is read and shared
        nodes run once. Give a micro-batch to this from ``foreachBatch`` to fan out a stream."""
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return df

        tables, lies = self._planned(rows, tuple(sinks), keep)
        try:
            for port, write in sinks.items():
                write(tables[lies[port]].select(*ROW, _column(port)))
        finally:
            for df in kept:
                df.unpersist()


def _column(port: str) -> str:
    return port.replace(".", "_")


#: Parameters of the live graph's gates, in the instruments' order.
LIVE_GATES = (
    OnsetParams("hfc", threshold=10, refractory=30, warmup=8, sensitivity=5, smooth_window=2, odf_window=64),
    OnsetParams("flux", threshold=1.4, refractory=4, warmup=8, sensitivity=1.8, smooth_window=2, odf_window=64),
    OnsetParams("flux", threshold=1.4, refractory=3, warmup=8, sensitivity=1.8, smooth_window=2, odf_window=48),
    OnsetParams("hfc", threshold=1.6, refractory=3, warmup=8, sensitivity=1.6, smooth_window=2, odf_window=48),
    OnsetParams("hfc", threshold=1.5, refractory=4, warmup=8, sensitivity=1.6, smooth_window=2, odf_window=64),
)
#: The live graph's lighting engine.
LIVE_LIGHTS = LightingParams(confidence_threshold=0.7, min_latency=0.07, max_latency=2.0, duplicate_window=0.4)


def live_graph(cutter: CutterParams | None = None, gates: tuple[OnsetParams, ...] = LIVE_GATES, lights: LightingParams = LIVE_LIGHTS, predict: PredictorParams | None = None) -> Graph:
    """Chunks of samples to frames, spectra, mel bands, instrument sums, five gates, predictions and light commands."""
    cutter = cutter or CutterParams(silent_frames="noise")
    rate = cutter.sample_rate
    g = Graph(("samples",))
    g.add("frames", frame_cutter(cutter), signal="samples")
    g.add("windowed", renaming(("frame",), "frame", lambda df: dsp.windowed(df, cutter.frame_size), "frame", "frame"), frame="frames.frame")
    g.add("spectrum", renaming(("frame",), "spectrum", dsp.spectrum, "frame", "spectrum"), frame="windowed.frame")
    g.add("mel", renaming(("spectrum",), "bands", lambda df: dsp.mel_bands(df, MelParams().bands, rate), "spectrum", "bands"), spectrum="spectrum.spectrum")
    g.add("instruments", column_operator(("bands",), "sums", lambda b: arrays.instrument_sum(b, MaskParams(sample_rate=rate))), bands="mel.bands")
    g.add("bank", gate_bank(gates), sums="instruments.sums")
    for i, name in enumerate(INSTRUMENTS):
        g.add(f"{name}_sum", column_operator(("array",), "value", lambda v, i=i: arrays.vector_index(v, i)), array="instruments.sums")
        g.add(f"{name}_gate", column_operator(("array",), "value", lambda v, i=i: arrays.vector_index(v, i)), array="bank.gates")
    g.add("pack", column_operator(INSTRUMENTS, "gates", arrays.pack5), **{n: f"{n}_gate.value" for n in INSTRUMENTS})
    g.add("predictor", predictor(predict or PredictorParams(sample_rate=rate, hop_size=cutter.hop_size)), gates="pack.gates")
    g.add("lighting", lighting_engine(lights), time="predictor.time", predictions="predictor.predictions")
    return g
