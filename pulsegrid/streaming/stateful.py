"""Machines of the batch operators as streaming state, and event-time operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = T.StructType([T.StructField("machine", T.BinaryType()), T.StructField("next", T.LongType()), T.StructField("held", T.BinaryType())])


def stateful(frames: DataFrame, make: Callable[[], object], schema: T.StructType, keys: tuple[str, ...] = ("stream_id",), max_held: int = 10_000, gap_ms: int | None = None) -> DataFrame:
    """Run one machine for each key of a streaming DataFrame with ``frame_idx`` from 0.

    Rows may come out of order within and across micro-batches: those beyond the next expected frame are held in state
    until the gap is filled or more than ``max_held`` wait; then the missing frames count as lost. With ``gap_ms`` they
    also do when that long no new row of the key came; that runs empty micro-batches to look at clocks, so give the query a
    trigger interval. Repeated and late frames are dropped. The machine is the one of the batch operator, so both give the
    same rows where no frame is lost.
    """
    outputs = schema.names

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, expected, held = make(), 0, None
        if state.exists:
            raw, expected, kept = state.get
            machine, held = pickle.loads(raw), pickle.loads(kept)
        lost = state.hasTimedOut
        parts = [b for b in ((held,) if lost else (held, *batches)) if b is not None and len(b)]
        rows = pd.concat(parts) if parts else None
        while rows is not None and len(rows):
            rows = rows[rows["frame_idx"] >= expected].drop_duplicates("frame_idx").sort_values("frame_idx").reset_index(drop=True)
            if len(rows) and (lost or len(rows) > max_held) and rows["frame_idx"].iloc[0] > expected:
                expected, lost = int(rows["frame_idx"].iloc[0]), False
            ready = rows["frame_idx"] == expected + pd.Series(range(len(rows)))
            now, rows = rows[ready].reset_index(drop=True), rows[~ready].reset_index(drop=True)
            if len(now):
                made = machine.process(now)
                yield (made if isinstance(made, pd.DataFrame) else now.assign(**made))[outputs]
                expected += len(now)
            if len(rows) <= max_held:
                break
        waiting = rows if rows is not None and len(rows) else None
        state.update((pickle.dumps(machine), expected, pickle.dumps(waiting)))
        if waiting is not None and gap_ms is not None:
            state.setTimeoutDuration(gap_ms)

    timeout = GroupStateTimeout.NoTimeout if gap_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return frames.groupBy(*keys).applyInPandasWithState(step, schema, STATE, "append", timeout)


def _schema(keys: tuple[str, ...], **columns: T.DataType) -> T.StructType:
    kinds = {"stream_id": T.LongType(), "frame_idx": T.LongType(), "band": T.IntegerType()}
    return T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField(k, t) for k, t in columns.items()])


_FRAME = ("stream_id", "frame_idx")
_D, _L = T.DoubleType(), T.LongType()


def onset_gate_stream(frames: DataFrame, params) -> DataFrame:
    from ..operators.gates import OnsetGate

    return stateful(frames.select(*_FRAME, "x"), lambda: OnsetGate(params), _schema(_FRAME, odf=_D, smoothed=_D, threshold=_D, hit=_L))


def onset_gate_vector_stream(frames: DataFrame, params) -> DataFrame:
    from ..operators.gates import OnsetBandGate

    bands = frames.where(F.size("bands") > 0).select(*_FRAME, F.posexplode("bands").alias("band", "x"))
    return stateful(bands, lambda: OnsetBandGate(params), _schema((*_FRAME, "band"), hit=_L), ("stream_id", "band"))


def multiframe_gate_stream(frames: DataFrame, params) -> DataFrame:
    from ..operators.gates import MultiFrameGate

    return stateful(frames.select(*_FRAME, "x"), lambda: MultiFrameGate(params), _schema(_FRAME, hit=_L))


def quantile_gate_stream(frames: DataFrame, params) -> DataFrame:
    from ..operators.gates import QuantileGate

    return stateful(frames.select(*_FRAME, "x"), lambda: QuantileGate(params), _schema(_FRAME, hit=_L))


def beat_kalman_stream(beats: DataFrame, params) -> DataFrame:
    """``frame_idx`` numbers the beats of a stream from 0."""
    from ..operators.tracking import BeatKalman

    return stateful(beats.select(*_FRAME, "t"), lambda: BeatKalman(params), _schema(_FRAME, phase=_D, period=_D, std=_D))


def clock_offset_stream(samples: DataFrame, alpha: float = 0.1) -> DataFrame:
    from ..operators.tracking import ClockOffset

    return stateful(samples.select(*_FRAME, "t", "wall"), lambda: ClockOffset(alpha), _schema(_FRAME, clock_offset=_D))


def predictor_stream(frames: DataFrame, params) -> DataFrame:
    from ..operators.tracking import OUTPUT, InstrumentPredictor

    return stateful(frames.select("stream_id", "frame_idx", "gates"), lambda: InstrumentPredictor(params), OUTPUT)


def device_queue_stream(arrivals: DataFrame, params, late: str = "0 seconds") -> DataFrame:
    """The device queue over arrivals with an event time ``ts`` beside their ``arrival_us``.

    Arrivals run what was due before them; without arrivals, timers do, as soon as the watermark passes the next due time.
    Arrivals of a micro-batch are taken in order of arrival_us and seq.
    """
    from ..operators.device import EXECUTION, DeviceQueue

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else DeviceQueue(params)
        if state.hasTimedOut:
            out = pd.DataFrame(machine.run_until(state.getCurrentWatermarkMs() * 1000), columns=EXECUTION.names)
        else:
            rows = [b for b in batches if len(b)]
            out = machine.process(pd.concat(rows).sort_values(["arrival_us", "seq"])) if rows else pd.DataFrame(columns=EXECUTION.names)
        if len(out):
            yield out
        state.update((pickle.dumps(machine), 0, pickle.dumps(None)))
        if machine.queue:
            state.setTimeoutTimestamp(max(machine.queue[0][0] // 1000, state.getCurrentWatermarkMs() + 1))

    columns = ["stream_id", "arrival_us", "seq", "execute_time_us", "red", "green", "blue", "event_id", "ts"]
    timed = arrivals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(*columns)
    return timed.groupBy("stream_id").applyInPandasWithState(step, EXECUTION, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def dedup_commands(commands: DataFrame, within: str = "2 seconds") -> DataFrame:
    """First command of each event_id within the watermark of its timestamp ``ts``."""
    return commands.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(["stream_id", "event_id"])


def hit_windows(hits: DataFrame, length: str = "10 seconds", slide: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """Hits of every instrument in sliding windows of event time ``ts``."""
    timed = hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length, slide), "instrument").agg(F.count(F.lit(1)).alias("hits"), F.sum("x").alias("energy")).select(F.col("window.start").alias("start"), "instrument", "hits", "energy")


def to_sinks(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands every micro-batch to ``write(batch, id)``: fan-out to several sinks from one read."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").start()
