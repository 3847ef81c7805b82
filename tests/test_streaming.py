"""Streams give the rows of batches, also when micro-batches split a stream and rows come late."""

import numpy as np

from pulsegrid.operators.gates import onset_gate
from pulsegrid.params import OnsetParams
from pulsegrid.streaming.stateful import dedup_commands, onset_gate_stream, to_sinks

PARAMS = OnsetParams("hfc", threshold=0.5, refractory=3, warmup=4, smooth_window=2, odf_window=16)


def test_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(9).gamma(2, 10, 80)
    rows = [(s, i, float(x[i] + s)) for s in (1, 2) for i in range(80)]
    schema = "stream_id long, frame_idx long, x double"
    parts = [rows[:30] + rows[80:101], rows[32:60] + rows[101:120], rows[30:32] + rows[60:80] + rows[120:]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    (tmp_path / "src").mkdir()
    for n in range(3):
        for p in (tmp_path / f"in{n}").glob("*.parquet"):
            p.rename(tmp_path / "src" / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    got = []
    q = to_sinks(onset_gate_stream(stream, PARAMS), lambda df, n: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    want = [tuple(r) for r in onset_gate(spark.createDataFrame(rows, schema), PARAMS).collect()]
    key = lambda r: (r[0], r[1], r[5])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_commands_are_sent_once(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, "kick_1.00", t), (1, "kick_1.00", t), (1, "kick_2.00", t)]
    spark.createDataFrame(rows, "stream_id long, event_id string, ts timestamp_ntz").write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("stream_id long, event_id string, ts timestamp_ntz").parquet(str(tmp_path / "src"))
    got = []
    q = to_sinks(dedup_commands(stream), lambda df, n: got.extend(r["event_id"] for r in df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == ["kick_1.00", "kick_2.00"]
