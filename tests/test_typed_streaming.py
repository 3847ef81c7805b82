"""Typed state with timers and times to live, channels that publish once, and frames as streams."""

import datetime as dt
import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import aggregates, frames
from pulsegrid.params import INSTRUMENTS, CutterParams
from pulsegrid.sources import channels, exchange, samples
from pulsegrid.streaming import typed

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


class Feed:
    """A streaming source of Parquet files that are written one by one."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "src").mkdir(parents=True)

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.folder / f"w{self.n}"))
        for p in (self.folder / f"w{self.n}").glob("*.parquet"):
            p.rename(self.folder / "src" / f"{self.n:03}.parquet")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "src"))


def started(df, folder, got):
    return df.writeStream.foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(folder / "ck")).outputMode("append").start()


def drained(df, folder):
    got = []
    q = started(df, folder, got)
    try:
        q.processAllAvailable()
        return got, q.lastProgress
    finally:
        q.stop()


TOKENS = "stream_id long, frame_idx long, name string, value double, ts timestamp"


def test_zip_of_shuffled_and_late_tokens(spark, tmp_path):
    """Frames come as soon as all five tokens are there, incomplete ones with zeros once the watermark passes, each once."""
    r = random.Random(2)
    rows = [(s, k, n, float(r.random() < 0.4), at(100 * k)) for s in (1, 2) for k in range(30) for n in INSTRUMENTS if not (k % 7 == 3 and n == "clap")]
    rows += [x for x in rows if x[1] % 5 == 0]
    rows.sort(key=lambda x: x[1] + r.randrange(8))
    feed = Feed(spark, tmp_path, TOKENS)
    for a in range(0, len(rows), 60):
        feed.put(rows[a : a + 60])
    feed.put([(9, 0, "kick", 1.0, at(60_000))])
    feed.put([(9, 1, "kick", 1.0, at(120_000))])
    streams = {n: feed.stream().where(F.col("name") == n) for n in reversed(INSTRUMENTS)}
    got, progress = drained(typed.zip_gates(streams, "2 seconds"), tmp_path)
    want = {}
    for s, k, n, v, _ in rows:
        want.setdefault((s, k), dict.fromkeys(INSTRUMENTS, 0.0))[n] = v
    mine = {x[:2]: x for x in got if x[0] != 9}
    assert len(mine) == len([x for x in got if x[0] != 9]) == 60
    assert all(list(mine[k][2]) == list(want[k].values()) and mine[k][3] == (4 if k[1] % 7 == 3 else 5) for k in want)
    assert sum(o["numRowsTotal"] for o in [json.loads(progress.json if isinstance(progress.json, str) else "{}")] if "numRowsTotal" in o) == 0
    with pytest.raises(ValueError):
        typed.zip_gates({"kick": feed.stream()})


EVENTS = "stream_id long, instrument string, t_us long, n long"


def test_trailing_counts_are_the_batch_windows(spark, tmp_path):
    r = random.Random(4)
    base = int(START.timestamp() * 1_000_000)
    rows = [(s, i, base + r.randrange(60) * 500_000, r.randrange(1, 4)) for s in (1, 2) for i in ("kick", "snare") for _ in range(80)]
    rows.sort(key=lambda x: x[2] + r.randrange(4_000_000))
    feed = Feed(spark, tmp_path, EVENTS)
    for a in range(0, len(rows), 70):
        feed.put(rows[a : a + 70])
    feed.put([(5, "ohc", base + 600_000_000, 1)])
    feed.put([(5, "ohc", base + 700_000_000, 1)])
    got, _ = drained(typed.trailing_counts(feed.stream(), 10, "5 seconds"), tmp_path)
    want = [tuple(x) for x in aggregates.trailing_counts(spark.createDataFrame(rows, EVENTS), 10).collect()]
    assert sorted(x for x in got if x[0] != 5) == sorted(want) and len(want) == 320


PREDICTED = "stream_id long, instrument string, frame_idx long, hit_index int, t_pred_sec double, ts timestamp, due_ms long"


def test_release_at_due_times(spark, tmp_path):
    """Nothing before it is due, everything once, in order of due times; the last ones by timers alone."""
    base = int(START.timestamp() * 1000)
    feed = Feed(spark, tmp_path, PREDICTED)
    row = lambda s, k, now, due: (s, "kick", k, 1, due / 1000, at(now), base + due)
    feed.put([row(1, 0, 0, 500), row(1, 1, 0, 300), row(2, 0, 0, 10_000), row(1, 1, 0, 300)])
    feed.put([row(3, 0, 400, 20_000)])
    feed.put([row(3, 1, 1000, 20_000)])
    feed.put([row(3, 2, 12_000, 60_000)])
    feed.put([row(3, 3, 12_000, 70_000)])
    got = []
    q = started(typed.release_when_due(feed.stream()), tmp_path, got)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(x[0], x[2], x[5] - base) for x in got] == [(1, 1, 300), (1, 0, 500), (2, 0, 10_000)]
    feed.put([row(4, 0, 65_000, 99_000)])  # a restart goes on from the checkpoint
    feed.put([row(4, 1, 65_000, 99_000)])
    got.clear()
    q = started(typed.release_when_due(feed.stream()), tmp_path, got)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((x[0], x[2], x[5] - base) for x in got) == [(3, 0, 20_000), (3, 1, 20_000), (3, 2, 60_000)]


COMMANDS = "stream_id long, event_id string, frame_idx long, ts timestamp"


def test_dedup_in_event_time_forgets(spark, tmp_path):
    """An id passes again after its window, and of an endless stream only the last window's ids are kept."""
    feed = Feed(spark, tmp_path, COMMANDS)
    for k in range(12):
        feed.put([(1, f"e{k}", 2 * k, at(1000 * k)), (1, f"e{k}", 2 * k + 1, at(1000 * k + 200)), (1, "again", 100 + k, at(1000 * k))])
    got, sizes = [], []
    q = started(typed.dedup_in_event_time(feed.stream(), 2000, "0 seconds"), tmp_path, got)
    try:
        q.processAllAvailable()
        sizes = [s["numRowsTotal"] for p in q.recentProgress for s in (json.loads(p.json)["stateOperators"] if not isinstance(p, dict) else p["stateOperators"])]
    finally:
        q.stop()
    assert sorted(x[1] for x in got if x[1] != "again") == sorted(f"e{k}" for k in range(12))
    again = sorted(x[2] - 100 for x in got if x[1] == "again")
    assert again[0] == 0 and all(b - a >= 2 for a, b in zip(again, again[1:])) and len(again) >= 3
    assert max(sizes[6:]) <= 2 * max(sizes[:6])


def awaited(reached, seconds=60):
    """Whether something comes true in time; queries that look at clocks have always more batches to run."""
    end = time.time() + seconds
    while not reached() and time.time() < end:
        time.sleep(0.2)
    return reached()


def test_dedup_with_time_to_live(spark, tmp_path):
    feed = Feed(spark, tmp_path, COMMANDS)
    feed.put([(1, "a", 0, at(0)), (1, "a", 1, at(1)), (1, "b", 2, at(2)), (2, "a", 3, at(3))])
    got, seen = [], []

    def take(batch, n):
        rows = [tuple(r) for r in batch.collect()]
        got.extend(rows)
        seen.append(n)

    q = typed.dedup_with_ttl(feed.stream(), 15_000).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="2 seconds").start()
    try:
        assert awaited(lambda: len(got) == 3) and sorted(x[2] for x in got) == [0, 2, 3]
        feed.put([(1, "a", 4, at(4)), (1, "c", 5, at(4))])
        assert awaited(lambda: len(got) == 4) and got[3][2] == 5
        time.sleep(15)
        feed.put([(1, "a", 6, at(5))])
        assert awaited(lambda: len(got) == 5) and got[4][2] == 6
    finally:
        q.stop()


def test_frame_stream_is_the_batch(spark, tmp_path):
    """Chunks of any sizes, late and twice."""
    rng = np.random.default_rng(3)
    rows, at_ = [], 0
    x = np.round(rng.normal(size=500), 3)
    x[100:200] = 0
    while at_ < len(x):
        n = int(rng.integers(0, 30))
        rows.append((1, len(rows), x[at_ : at_ + n].tolist()))
        at_ += n
    schema, p = "stream_id long, chunk_idx long, samples array<double>", CutterParams(32, 12, silent_frames="noise", seed=1)
    feed = Feed(spark, tmp_path, schema)
    for part in (rows[:5] + rows[9:12], rows[5:9] + rows[3:7], rows[12:]):
        feed.put(part)
    got, _ = drained(frames.frame_stream(feed.stream(), p), tmp_path)
    want = frames.chunk_frames(spark.createDataFrame(rows, schema), p).collect()
    assert len(got) == len(want) > 30 and sorted(got) == sorted(map(tuple, want))


def payloads(spark, path):
    return sorted((r["topic"], r["payload"]) for r in spark.read.format("pulsegrid_channel").option("path", path).load().collect())


def test_channel_publishes_once(spark, tmp_path):
    """Retries before and after a read, failed tasks' files and two publishers."""
    exchange.register(spark)
    path = str(tmp_path / "c")
    write = exchange.StreamPublisher(path, "main")
    row = lambda n: {"topic": "t", "payload": f"p{n}\nü"}
    first = [write.write(iter([row(0), row(1), {"topic": "t", "payload": None}])), write.write(iter([]))]
    assert payloads(spark, path) == []  # not committed
    write.commit(first, 0)
    assert payloads(spark, path) == [("t", "p0\nü"), ("t", "p1\nü")]
    again = [write.write(iter([row(0), row(1)]))]
    write.commit(again, 0)  # the batch is retried after a read
    lost = [write.write(iter([row(7)]))]
    write.abort(lost, 1)
    assert payloads(spark, path) == [("t", "p0\nü"), ("t", "p1\nü")] and len(os.listdir(f"{path}/data")) == 1
    spark.createDataFrame([("u", "x")], "topic string, payload string").write.format("pulsegrid_channel").option("path", path).option("publisher", "other").mode("append").save()
    assert ("u", "x") in payloads(spark, path) and len(payloads(spark, path)) == 3
    with pytest.raises(Exception, match="letters"):
        spark.createDataFrame([("u", "x")], "topic string, payload string").write.format("pulsegrid_channel").option("path", path).option("publisher", "a/b").mode("append").save()


def test_channel_streams(spark, tmp_path):
    """A query publishes, another follows; the follower restarts and sees every message once."""
    exchange.register(spark)
    path = str(tmp_path / "c")
    feed = Feed(spark, tmp_path, "topic string, payload string")
    for k in range(3):
        feed.put([("gates", f"{k}-{i}") for i in range(4)])
    out = feed.stream().writeStream.format("pulsegrid_channel").option("path", path).option("checkpointLocation", str(tmp_path / "pub")).start()
    out.processAllAvailable()
    out.stop()
    got, follow = [], lambda: started(spark.readStream.format("pulsegrid_channel").option("path", path).load().select("payload"), tmp_path, got)
    q = follow()
    q.processAllAvailable()
    q.stop()
    assert sorted(x[0] for x in got) == [f"{k}-{i}" for k in range(3) for i in range(4)]
    feed.put([("gates", "new"), (None, None)])
    out = feed.stream().writeStream.format("pulsegrid_channel").option("path", path).option("checkpointLocation", str(tmp_path / "pub")).start()
    out.processAllAvailable()
    out.stop()
    got.clear()
    q = follow()
    q.processAllAvailable()
    q.stop()
    assert got == [("new",)]


def test_a_finished_batch_is_not_published_again(spark, tmp_path):
    """The plain text channel: a retry after a read writes no second copy."""
    texts = spark.createDataFrame([("gates", "{}"), ("gates", "[]")], "topic string, payload string")
    publish, path = channels.publisher(str(tmp_path / "c")), str(tmp_path / "c")
    got = []
    for _ in range(2):
        publish(texts, 0)
        (tmp_path / "f").mkdir(exist_ok=True)
        q = started(channels.message_stream(spark, path), tmp_path / "f", got)
        q.processAllAvailable()
        q.stop()
    assert len(got) == 2


def test_stream_ids_do_not_move(spark, tmp_path):
    """A file that arrives later changes no other file's id, in batches and in a running stream."""
    samples.register(spark)
    np.arange(600, dtype="<f4").tofile(tmp_path / "b.f32")
    load = lambda r: r.format("pulsegrid_samples").option("path", str(tmp_path / "*.f32")).option("chunk", 256).load()
    ids = lambda rows: {os.path.basename(r["path"] if not isinstance(r, tuple) or hasattr(r, "path") else r[1]): r[0] for r in rows}
    before = ids(load(spark.read).collect())
    got = []
    q = started(load(spark.readStream), tmp_path, got)
    q.processAllAvailable()
    np.arange(600, dtype="<f4").tofile(tmp_path / "a.f32")
    q.processAllAvailable()
    q.stop()
    after = ids(load(spark.read).collect())
    assert after["b.f32"] == before["b.f32"] == next(r[0] for r in got if r[1].endswith("b.f32")) and {r[0] for r in got} == set(after.values()) and len(set(after.values())) == 2
