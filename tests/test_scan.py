"""Ordered scans over many short keys."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.operators import matching, scan, segments


def test_short_keys_cost_no_table_each(monkeypatch):
    """A thousand keys in two batches, the middle one cut by the batches' border, give one table a batch and one at the end."""
    n, rng = 1001 * 4, np.random.default_rng(1)
    rows = pd.DataFrame({"stream_id": np.arange(n) // 4, "segment": 0, "frame_idx": np.arange(n) % 4, "d": rng.random(n), "_nth": np.arange(n) % 4 + 1})
    made, real = [], pd.DataFrame
    monkeypatch.setattr(scan.pd, "DataFrame", lambda *a, **k: made.append(1) or real(*a, **k))
    out = list(scan._light(iter([rows[:2002].copy(), rows[2002:].copy()]), lambda: segments._Summaries(segments.ExponentialMean()), segments._MAP))
    monkeypatch.undo()
    assert len(made) == len(out) == 3
    whole = pd.concat(out)
    assert whole["stream_id"].tolist() == list(range(1001))
    for stream in (0, 500, 1000):
        d = rows["d"].to_numpy()[stream * 4 : stream * 4 + 4]
        want = segments.ExponentialMean().summary({"d": d})
        assert segments.pickle.loads(whole["map"].iloc[stream]) == want


def test_matches_of_many_short_keys(spark):
    """Each key has a pair, a lone hit and a lone prediction; keys without predictions and a null stream are kept."""
    hits = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("stream_id"), F.lit("kick").alias("instrument"), F.explode(F.array(F.lit(1.0), F.lit(5.0))).alias("t"))
    told = spark.range(0, 3000, 3).select(F.when(F.col("id") > 0, F.col("id")).alias("stream_id"), F.lit("kick").alias("instrument"), (F.col("id") + 7).alias("frame_idx"), F.lit(1).alias("hit_index"), F.explode(F.array(F.lit(1.01), F.lit(9.0))).alias("t_pred_sec"))
    out = matching.matches(told, hits).toPandas()
    assert len(out) == 3000 * 2 + 1000 * 2 - 1000
    assert out["stream_id"].isna().sum() == 3 and (out["t_pred"].notna() & out["t_hit"].notna()).sum() == 1000
    alone = out[out["t_hit"].isna()]
    assert len(alone) == 1000 and (alone["frame_idx"] - alone["stream_id"].fillna(0) == 7).all()


def test_payloads_are_written_and_parsed_once(spark, sf):
    """No condition writes a prediction's text or parses it again: both stand once in the plan."""
    from pulsegrid.plans import queries

    plan = queries.QUERIES["prediction_payloads"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("timestamp_sec\": ") <= 1 and plan.count("from_json") == 1


def test_predictor_in_batches_is_the_machine(spark, monkeypatch):
    """Messages of the Arrow step, also across its pieces, are those of one machine walked row by row; short, null and missing gates."""
    from pulsegrid.operators import tracking
    from pulsegrid.params import PredictorParams

    params = PredictorParams(sample_rate=40960.0, hop_size=4096)
    rng = np.random.default_rng(5)
    gates = [None if i % 31 == 7 else [1.0, 0.0] if i % 29 == 3 else [float(v) for v in rng.random(6) < 0.3] for i in range(300)]
    rows = [(s, i, g) for s in (1, 2) for i, g in enumerate(gates)]
    monkeypatch.setattr(tracking, "ROWS", 7)
    got = tracking.instrument_predictor(spark.createDataFrame(rows, "stream_id long, frame_idx long, gates array<double>"), params).orderBy("stream_id", "frame_idx").collect()
    want = tracking.InstrumentPredictor(params).process(pd.DataFrame({"stream_id": 1, "frame_idx": range(300), "gates": gates}))
    assert len(got) == 2 * len(want) and sum(len(p["hits"]) for r in got for p in r["predictions"]) > 100
    for k, r in enumerate(got):
        w = want.iloc[k % len(want)]
        assert (r["frame_idx"], r["timestamp_sec"]) == (w["frame_idx"], w["timestamp_sec"])
        assert [p.asDict(True) for p in r["predictions"]] == w["predictions"]


def test_accuracy_sorts_a_prediction_once(spark):
    """Intervals around their prediction, beside it and without ends against plain Python; only those beside it are sorted twice."""
    from pulsegrid.operators import aggregates

    rng = np.random.default_rng(9)
    times = np.round(rng.random(60) * 20, 1).tolist()
    told = []
    for i in range(400):
        t = round(float(rng.random() * 22 - 1), 1)
        lo, hi = [(t - 0.1, t + 0.1), (t, t), (t + 0.2, t + 0.5), (t - 0.5, t - 0.2), (None, t), (t, None)][i % 6]
        told.append((1, "kick", i, 1, t, lo, hi))
    columns = "stream_id long, instrument string, frame_idx long, hit_index int, t_pred_sec double, ci_low_sec double, ci_high_sec double"
    hits = spark.createDataFrame([(1, "kick", t) for t in times], "stream_id long, instrument string, t double")
    got = {r["frame_idx"]: r for r in aggregates.accuracy(spark.createDataFrame(told, columns), hits).collect()}
    for _, _, i, _, t, lo, hi in told:
        assert got[i]["next_hit"] == min((h for h in times if h >= t), default=None) and got[i]["last_hit"] == max((h for h in times if h < t), default=None)
        assert got[i]["in_interval"] == (hi is not None and any((lo is None or lo <= h) and h <= hi for h in times))  # as before: no lower end bounds nothing
    plan = aggregates.accuracy(spark.createDataFrame(told, columns), hits)._jdf.queryExecution().analyzed().toString()
    assert "Union" in plan and re.search("Filter NOT coalesce.*ci_low_sec.*t_pred_sec.*ci_high_sec", plan)
