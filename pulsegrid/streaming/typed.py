"""Keyed state with typed values, lists and maps, times to live and timers.

Every operator is a ``StatefulProcessor``: what it keeps has a schema of its own, is read and written entry by entry, and is
removed by a time to live or by a timer. So state is bounded by what is open, however long a stream runs, and comes back from
a checkpoint. The state store is RocksDB, which these operators need.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..params import INSTRUMENTS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    rows.sparkSession.conf.set(_STORE, _ROCKS)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode)


def _late(timers) -> int:
    return timers.getCurrentWatermarkInMs()


class Forgetting(StatefulProcessor):
    """First row of each ``name`` of a key; a name is forgotten ``ttl_ms`` after it was last written (processing time)."""

    def __init__(self, name: str, ttl_ms: int, refresh: bool):
        self.name, self.ttl_ms, self.refresh = name, ttl_ms, refresh

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "name string", "n long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            names, new = part[self.name].astype(str).tolist(), []
            for name in names:
                known = self.seen.containsKey((name,))
                new.append(not known)
                if not known or self.refresh:
                    self.seen.updateValue((name,), ((self.seen.getValue((name,))[0] if known else 0) + 1,))
            if any(new):
                yield part[new]

    def close(self) -> None:
        pass


def dedup_with_ttl(commands: DataFrame, ttl_ms: int = 2000, name: str = "event_id", refresh: bool = False) -> DataFrame:
    """First command of each ``name`` in a stream until ``ttl_ms`` of processing time passed since (``refresh``: since it was last seen).

    Processing time looks at the clock in empty micro-batches too, so give the query a trigger interval.
    """
    return _run(commands, ["stream_id"], Forgetting(name, ttl_ms, refresh), commands.schema.simpleString()[7:-1].replace(":", " "), "ProcessingTime")


class FirstInWindow(StatefulProcessor):
    """The first row of a key; a timer removes it ``window_ms`` of event time later."""

    def __init__(self, time: str, window_ms: int):
        self.time, self.window_ms = time, window_ms

    def init(self, handle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        part = pd.concat(list(rows)).sort_values(self.time, kind="stable")
        if not self.until.exists() and len(part):
            until = int(part[self.time].iloc[0].timestamp() * 1000) + self.window_ms
            self.until.update((until,))
            self.handle.registerTimer(max(until, _late(timerValues) + 1))
            yield part.iloc[:1]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedup_in_event_time(commands: DataFrame, window_ms: int = 2000, late: str = "1 second") -> DataFrame:
    """First command of each event_id of a stream (in event time ``ts`` within a micro-batch, else the first to arrive); the same id
    passes again once the watermark is ``window_ms`` behind it. Only ids of the last window are kept."""
    timed = commands.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return _run(timed, ["stream_id", "event_id"], FirstInWindow("ts", window_ms), timed.schema.simpleString()[7:-1].replace(":", " "), "EventTime")


class DueRelease(StatefulProcessor):
    """Holds rows until the watermark passes their due time."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due_ms long, instrument string, hit_index int, frame_idx long", "t_pred_sec double")
        self.next = handle.getValueState("next", "ms long")

    def _arm(self, timers) -> None:
        """One timer a key: the earliest due time that waits."""
        if self.next.exists():
            self.handle.deleteTimer(self.next.get()[0])
            self.next.clear()
        due = min((k[0] for k in self.waiting.keys()), default=None)
        if due is not None:
            at = max(due, _late(timers) + 1)
            self.handle.registerTimer(at)
            self.next.update((at,))

    def _released(self, key, now: int) -> pd.DataFrame | None:
        due = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] <= now)
        for k, _ in due:
            self.waiting.removeKey(k)
        return pd.DataFrame([(key[0], k[1], k[3], k[2], t, k[0]) for k, t in due], columns=["stream_id", "instrument", "frame_idx", "hit_index", "t_pred_sec", "due_ms"]) if due else None

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            for r in part.itertuples():
                self.waiting.updateValue((int(r.due_ms), r.instrument, int(r.hit_index), int(r.frame_idx)), (float(r.t_pred_sec),))
        out = self._released(key, _late(timerValues))
        self._arm(timerValues)
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.next.clear()
        out = self._released(key, max(_late(timerValues), expiredTimerInfo.getExpiryTimeInMs()))
        self._arm(timerValues)
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def release_when_due(predictions: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Predictions (stream_id, instrument, frame_idx, hit_index, t_pred_sec, ts: when they came, due_ms: when they are due), each once its
    due time is reached by the watermark of ts; repeated ones once."""
    timed = predictions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("stream_id", "instrument", "frame_idx", "hit_index", "t_pred_sec", "ts", "due_ms")
    return _run(timed, ["stream_id"], DueRelease(), "stream_id long, instrument string, frame_idx long, hit_index int, t_pred_sec double, due_ms long", "EventTime")


class Zip(StatefulProcessor):
    """The values of one frame by name until all are there or the watermark passes the frame; then ``done`` until it is that far."""

    def __init__(self, names: tuple[str, ...]):
        self.names = names

    def init(self, handle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "name string", "value double")
        self.done = handle.getValueState("done", "done boolean")

    def _row(self, key) -> pd.DataFrame:
        found = {k[0]: v[0] for k, v in self.values.iterator()}
        self.values.clear()
        return pd.DataFrame([(*key, [found.get(n, 0.0) for n in self.names], len(found))], columns=["stream_id", "frame_idx", "gates", "n_found"])

    def handleInputRows(self, key, rows, timerValues):
        part = pd.concat(list(rows))
        if self.done.exists() or not len(part):
            return
        if not self.values.exists():
            self.handle.registerTimer(max(int(part["ts"].max().timestamp() * 1000), _late(timerValues)) + 1)
        for name, value in zip(part["name"].tolist(), part["value"].tolist()):
            if name in self.names and not self.values.containsKey((name,)):
                self.values.updateValue((name,), (float(value),))
        if sum(1 for _ in self.values.keys()) == len(self.names):
            self.done.update((True,))
            yield self._row(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.done.exists():
            self.done.clear()
        elif self.values.exists():
            yield self._row(key)

    def close(self) -> None:
        pass


def zip_streams(streams: dict[str, DataFrame], late: str = "1 second") -> DataFrame:
    """stream_id, frame_idx, gates and n_found: one token of each of the named streams (stream_id, frame_idx, value, ts) a frame, in the
    order of their names; the first token of a name counts, a frame is given once.

    A frame is given as soon as all its tokens are there, or with zeros for missing ones once the watermark of ``ts`` passes it.
    """
    union = None
    for name, df in streams.items():
        rows = df.select("stream_id", "frame_idx", F.lit(name).alias("name"), F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts")).where("value is not null")
        union = rows if union is None else union.unionByName(rows)
    return _run(union.withWatermark("ts", late), ["stream_id", "frame_idx"], Zip(tuple(streams)), "stream_id long, frame_idx long, gates array<double>, n_found int", "EventTime")


def zip_gates(streams: dict[str, DataFrame], late: str = "1 second") -> DataFrame:
    """``zip_streams`` of the five instruments' gates, in their order."""
    if set(streams) != set(INSTRUMENTS):
        raise ValueError(f"one stream each of {', '.join(INSTRUMENTS)}")
    return zip_streams({n: streams[n] for n in INSTRUMENTS}, late)


class TrailingCounts(StatefulProcessor):
    """Counts of the last ``span_us`` at every row of a key, in order of time: rows wait until the watermark is behind them, times
    leave when they are older than any row to come can see."""

    def __init__(self, span_us: int):
        self.span_us = span_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t_us long, n long")
        self.recent = handle.getListState("recent", "t_us long, n long")
        self.total = handle.getValueState("total", "n long")
        self.armed = handle.getValueState("armed", "ms long")

    def _given(self, key, watermark_ms: int, timers) -> pd.DataFrame | None:
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] < watermark_ms * 1000]
        rest = waiting[len(ready) :]
        out = []
        if ready:
            recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
            total = self.total.get()[0] if self.total.exists() else 0
            for t in sorted({r[0] for r in ready}):
                now = [r for r in ready if r[0] == t]
                total += sum(n for _, n in now)
                recent = [r for r in recent if r[0] > t - self.span_us] + now
                seen = sum(n for _, n in recent)
                out += [(*key, t, total, seen, seen / (self.span_us / 1e6))] * len(now)
            self.recent.put([r for r in recent])
            self.total.update((total,))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest and not self.armed.exists():
            at = max(rest[0][0] // 1000 + 1, _late(timers) + 1)
            self.handle.registerTimer(at)
            self.armed.update((at,))
        return pd.DataFrame(out, columns=["stream_id", "instrument", "t_us", "total", "recent", "rate"]) if out else None

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(t), int(n)) for part in rows for t, n in zip(part["t_us"].tolist(), part["n"].tolist())]
        if new:
            self.waiting.appendList(new)
        out = self._given(key, _late(timerValues), timerValues)
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.armed.clear()
        out = self._given(key, max(_late(timerValues), expiredTimerInfo.getExpiryTimeInMs()), timerValues)
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def trailing_counts(events: DataFrame, seconds: int = 10, late: str = "1 second") -> DataFrame:
    """``aggregates.trailing_counts`` of a stream of (stream_id, instrument, t_us since 1970, n): total so far, n of the last ``seconds`` and
    their rate at every row, once the watermark has passed it. What is kept of a key are the last ``seconds`` and its total."""
    timed = events.select("stream_id", "instrument", "t_us", F.col("n").cast("long").alias("n"), F.timestamp_micros("t_us").alias("ts")).withWatermark("ts", late)
    return _run(timed, ["stream_id", "instrument"], TrailingCounts(seconds * 1_000_000), "stream_id long, instrument string, t_us long, total long, recent long, rate double", "EventTime")
