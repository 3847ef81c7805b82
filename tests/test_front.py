"""Frames across chunks, segmented scans, quantiles, matches, moments and graphs, against plain Python."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import aggregates, dsp, frames, gates, graph, matching, moments, quantiles, segments, tracking
from pulsegrid.params import CutterParams, OnsetParams, PredictorParams, QuantileParams

CHUNKS = "stream_id long, chunk_idx long, samples array<double>"


def chunked(x, sizes, stream=1):
    """Chunks of the given sizes in turn; some are empty or null."""
    rows, at, sizes = [], 0, itertools.cycle(sizes)
    while at < len(x):
        n = next(sizes)
        rows.append((stream, len(rows), None if n is None else [float(v) for v in x[at : at + n]]))
        at += n or 0
    return rows


def cut(x, size, hop, pad=False):
    starts = range(0, len(x), hop) if pad else range(0, len(x) - size + 1, hop)
    return [list(x[a : a + size]) + [0.0] * (size - len(x[a : a + size])) for a in starts]


@pytest.mark.parametrize("sizes", [(1,), (7,), (64,), (3, 0, 50, None, 1), (1000,)])
@pytest.mark.parametrize("size, hop, pad", [(16, 5, False), (8, 8, True), (4, 9, False), (40, 3, True)])
def test_frames_do_not_see_chunks(spark, sizes, size, hop, pad):
    x = np.round(np.random.default_rng(1).normal(size=333), 3)
    df = spark.createDataFrame(chunked(x, sizes) + chunked(x[:20], sizes, 2), CHUNKS)
    alike = sizes[0] if len(sizes) == 1 and pad else 0
    out = frames.chunk_frames(df, CutterParams(size, hop, pad=pad, chunk_size=alike), frames_per_tile=5).orderBy("stream_id", "frame_idx").collect()
    for stream, samples in ((1, x), (2, x[:20])):
        got = [(r["frame_idx"], r["frame"]) for r in out if r["stream_id"] == stream]
        assert got == list(enumerate(map(list, cut(samples.tolist(), size, hop, pad))))


def test_chunk_starts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(frames, "BLOCK", 3)
    df = spark.createDataFrame(chunked(np.arange(100), (2, 5, 1)), CHUNKS)
    out = frames.placed(df).orderBy("chunk_idx").collect()
    assert [r["start"] for r in out] == [int(r["samples"][0]) for r in out]


def test_noise_is_quiet_and_the_same_for_any_cut(spark):
    x = np.concatenate((np.ones(40), np.zeros(80), np.ones(40)))
    p = CutterParams(16, 8, silent_frames="noise", seed=3)
    one, two = ({r["frame_idx"]: r["frame"] for r in frames.chunk_frames(spark.createDataFrame(chunked(x, s), CHUNKS), p).collect()} for s in ((7,), (160,)))
    silent = [k for k in one if not any(x[8 * k : 8 * k + 16])]
    assert one == two and silent and all(0 < max(map(abs, one[k])) <= frames.NOISE_LEVEL for k in silent)
    assert all(one[k] == x[8 * k : 8 * k + 16].tolist() for k in one if k not in silent)
    noise = np.concatenate([one[k] for k in silent[::2]])
    assert abs(noise.mean()) < 3e-6 and 4e-6 < noise.std() < 8e-6
    dropped = frames.chunk_frames(spark.createDataFrame(chunked(x, (7,)), CHUNKS), CutterParams(16, 8, silent_frames="drop"))
    assert {r["frame_idx"] for r in dropped.collect()} == set(one) - set(silent)


def test_null_samples_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, [1.0, None]), (1, 1, [2.0, 3.0])], CHUNKS)
    assert [r["frame"] for r in frames.chunk_frames(df, CutterParams(4, 4)).collect()] == [[1.0, 0.0, 2.0, 3.0]]
    assert frames.chunk_frames(spark.createDataFrame([], CHUNKS)).count() == 0


def stream(spark, x, name="x", stream_id=1):
    return spark.createDataFrame(pd.DataFrame({"stream_id": stream_id, "frame_idx": np.arange(len(x)), name: x}))


def same(a, b, column, digits=None):
    key = lambda df: {(r["stream_id"], r["frame_idx"]): r[column] for r in df.collect()}
    got, want = key(a), key(b)
    assert got.keys() == want.keys()
    if digits is None:
        assert got == want
    else:
        assert all(math.isclose(got[k], want[k], rel_tol=10**-digits, abs_tol=10**-digits) for k in want)


@pytest.mark.parametrize("length", [1, 7, 50, 1000])
@pytest.mark.parametrize("apart", [0, 1, 4, 30])
def test_segmented_refractory(spark, length, apart):
    rng = np.random.default_rng(apart)
    df = stream(spark, (rng.random(300) < 0.3).astype(int), "candidate").unionByName(stream(spark, np.ones(40, int), "candidate", 2))
    same(segments.refractory(df, apart, length), gates.refractory(df, apart), "hit")


@pytest.mark.parametrize("length", [3, 40])
@pytest.mark.parametrize("p", [QuantileParams(refractory=r, warmup=w) for r, w in ((0, 0), (1, 9), (5, 20))])
def test_segmented_quantile_gate(spark, length, p):
    rng = np.random.default_rng(p.refractory)
    df = stream(spark, rng.gamma(2, 10, 300)).unionByName(stream(spark, np.array([1.0, 2.0, 3.0]), stream_id=2))
    same(segments.quantile_gate(df, p, length), gates.quantile_gate(df, p), "hit")
    with pytest.raises(ValueError):
        segments.quantile_gate(df, QuantileParams(compat="textbook"))


@pytest.mark.parametrize("length", [40, 64])
@pytest.mark.parametrize("p", [OnsetParams(m, threshold=0.5, refractory=3, warmup=w, smooth_window=s, odf_window=16, compat=c) for m, w, s, c in (("hfc", 8, 2, "reference"), ("flux", 1, 3, "reference"), ("complex", 0, 1, "reference"), ("hfc", 5, 1, "reference"), ("rms", 6, 2, "reference"), ("hfc", 4, 2, "textbook"))])
def test_segmented_onset_gate(spark, length, p):
    rng = np.random.default_rng(p.warmup)
    df = stream(spark, np.round(rng.gamma(2, 10, 300), 3)).unionByName(stream(spark, np.array([1.0, 9.0, 2.0]), stream_id=2))
    same(segments.onset_gate(df, p, length), gates.onset_gate(df, p).select("stream_id", "frame_idx", "hit"), "hit")


def test_segmented_strength_that_never_falls(spark):
    """Ever larger values: no segment forgets where it started, so the map is a line and only rounding may differ."""
    x = np.cumsum(np.random.default_rng(4).random(200)) ** 2
    want, o = [0.0], 0.0
    for v in x[1:]:
        o = max(0.0, v - o)
        want.append(o)
    out = segments.segmented_scan(stream(spark, x), segments.Strength(1, True), 16).orderBy("frame_idx").toPandas()
    assert np.allclose(out["odf"], want, rtol=1e-12)


def test_segmented_clock_offset(spark):
    rng = np.random.default_rng(8)
    df = stream(spark, np.arange(300) * 0.1, "t").withColumn("wall", F.col("t") + F.rand(3) / 10)
    pinned = spark.createDataFrame(df.toPandas())
    same(segments.clock_offset(pinned, 0.1, 16), tracking.clock_offset(pinned), "clock_offset", 10)
    assert rng is not None and segments.clock_offset(pinned.limit(0)).count() == 0


def test_one_long_stream_is_many_tasks(spark):
    """Half a million frames of one stream lie in as many tasks as there are, not in one."""
    df = spark.range(500_000).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("frame_idx"), (F.col("id") % 3 == 0).cast("int").alias("candidate"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = segments.refractory(df, 4, 1 << 13).groupBy(F.spark_partition_id()).agg(F.sum("hit").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) > 1 and sum(r["n"] for r in out) == math.ceil(500_000 / 6)


def test_markers_estimate_quantiles():
    rng = np.random.default_rng(2)
    for x, worst in ((rng.normal(size=20_000), 0.06), (rng.gamma(2, 10, 20_000), 0.03), (rng.random(20_000), 0.02)):
        for q in (0.5, 0.8, 0.98):
            m = quantiles.Markers(q)
            for v in x.tolist():
                m.add(v)
            assert abs(m.value() - np.quantile(x, q)) <= worst * max(1.0, abs(np.quantile(x, q))) and len(m.height) == 5
    m = quantiles.Markers(0.8)
    for n, v in enumerate([3.0, 1.0, 2.0, 5.0, 4.0], 1):
        m.add(v)
        assert m.value() == pytest.approx(np.quantile([3.0, 1.0, 2.0, 5.0, 4.0][:n], 0.8))


def test_markers_in_the_published_example():
    """The worked example of Jain and Chlamtac (1985), whose median estimate after 20 values is 4.44."""
    m = quantiles.Markers(0.5)
    for v in (0.02, 0.15, 0.74, 3.39, 0.83, 22.37, 10.15, 15.43, 38.62, 15.92, 34.60, 10.28, 1.47, 0.40, 0.05, 11.39, 0.27, 0.42, 0.09, 11.37):
        m.add(v)
    assert m.value() == pytest.approx(4.44, abs=0.01)


def test_exact_running_quantiles_are_numpys_and_not_quadratic(spark):
    x = np.round(np.random.default_rng(3).normal(size=400), 2)
    out = quantiles.running_quantiles(stream(spark, x)).orderBy("frame_idx").toPandas()
    assert np.allclose(out["hi"], [np.quantile(x[: i + 1], 0.98) for i in range(400)]) and np.allclose(out["lo"], [np.quantile(x[: i + 1], 0.8) for i in range(400)])
    h, began = quantiles.Heaps(0.98), time.perf_counter()
    for v in np.random.default_rng(1).normal(size=200_000).tolist():
        h.add(v)
    assert time.perf_counter() - began < 5


def test_missing_values_change_no_quantile(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (1, 2, None)], "stream_id long, frame_idx long, x double")
    out = quantiles.running_quantiles(df).orderBy("frame_idx").collect()
    assert [(r["hi"] is None or math.isnan(r["hi"]), r["lo"]) for r in out][0][0] and [r["lo"] for r in out][1:] == [5.0, 5.0]


def test_sketches_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 5).alias("k"), F.rand(1).alias("value"))
    whole = quantiles.merged_sketches(quantiles.quantile_sketches(df, ["k"]).withColumn("all", F.lit(1)), ["all"])
    r = quantiles.sketch_quantiles(whole, [0.1, 0.5, 0.9]).first()
    assert r["n"] == 50_000 and all(abs(r[f"q{i}"] - q) < 0.02 for i, q in enumerate((0.1, 0.5, 0.9)))


def most_pairs(p, h, tol):
    """Size of the largest matching, by augmenting paths."""
    partner = {}

    def free(i, seen):
        for j, t in enumerate(h):
            if abs(p[i] - t) <= tol and j not in seen:
                seen.add(j)
                if j not in partner or free(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(free(i, set()) for i in range(len(p)))


PRED, HITS = "stream_id long, instrument string, frame_idx long, hit_index int, t_pred_sec double", "stream_id long, instrument string, t double"


def test_matches_are_one_to_one_and_as_many_as_can_be(spark):
    rng = np.random.default_rng(6)
    p = [(s, i, k, 1, float(rng.integers(0, 60)) / 10) for s in range(6) for i in ("kick", "snare") for k in range(int(rng.integers(0, 25)))]
    h = [(s, i, float(rng.integers(0, 60)) / 10) for s in range(6) for i in ("kick", "snare") for _ in range(int(rng.integers(0, 25)))]
    p.append((9, None, 0, 1, None))
    out = matching.matches(spark.createDataFrame(p, PRED), spark.createDataFrame(h, HITS), 0.25).toPandas()
    report = {(r["stream_id"], r["instrument"]): r for r in matching.match_report(matching.matches(spark.createDataFrame(p, PRED), spark.createDataFrame(h, HITS), 0.25)).collect()}
    for key in {x[:2] for x in p + h if x[0] != 9}:
        ps, hs = sorted(x[4] for x in p if x[:2] == key), sorted(x[2] for x in h if x[:2] == key)
        mine = out[(out.stream_id == key[0]) & (out.instrument == key[1])]
        assert sorted(mine.t_pred.dropna()) == ps and sorted(mine.t_hit.dropna()) == hs
        both = mine.dropna(subset=["t_pred", "t_hit"])
        assert len(both) == most_pairs(ps, hs, 0.25 + 1e-12) == report[key]["n_pairs"] and (abs(both.t_pred - both.t_hit) <= 0.25 + 1e-12).all()
        ordered = both.sort_values(["t_pred", "t_hit"])
        assert ordered.t_hit.is_monotonic_increasing
        r = report[key]
        assert r["precision"] == (len(both) / len(ps) if ps else None) and r["recall"] == (len(both) / len(hs) if hs else None)


def test_accuracy_of_a_long_stream(spark):
    """100,000 hits of one stream: linear once they are sorted."""
    hits = spark.range(100_000).selectExpr("1L as stream_id", "'kick' as instrument", "id * 0.5 as t")
    pred = spark.range(20_000).selectExpr("1L as stream_id", "'kick' as instrument", "id as frame_idx", "1 as hit_index", "id * 2.5 + 0.1 as t_pred_sec", "id * 2.5 as ci_low_sec", "id * 2.5 + 0.2 as ci_high_sec")
    began = time.perf_counter()
    out = aggregates.accuracy(pred, hits).agg(F.count(F.lit(1)).alias("n"), F.sum("abs_error").alias("e"), F.sum(F.col("in_interval").cast("int")).alias("i")).first()
    assert out["n"] == out["i"] == 20_000 and out["e"] == pytest.approx(2000, rel=1e-6) and time.perf_counter() - began < 30


VECTORS = "stream_id long, bands array<double>"


def cov_of(spark, rows, parts):
    df = spark.createDataFrame(rows, VECTORS).repartition(parts)
    return {(r["stream_id"], r["i"], r["j"]): (r["n"], r["cov"]) for r in moments.covariance(df).collect()}


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_covariance_of_mixed_widths_far_from_zero(spark, parts):
    """Each pair over the rows that hold both, whatever rows share a task; an offset of 1e9 cancels nothing."""
    rng = np.random.default_rng(0)
    rows = [(int(s), [1e9 + float(v) for v in rng.integers(0, 4, w)]) for s, w in zip(rng.integers(0, 3, 200), rng.integers(0, 5, 200))]
    rows += [(7, [1e9, 1.0]), (7, [1e9 + 1, 2.0]), (8, None), (8, []), (None, [1.0, 2.0]), (None, [3.0, 5.0])]
    got = cov_of(spark, rows, parts)
    want = {}
    for s in {r[0] for r in rows}:
        for i, j in itertools.combinations_with_replacement(range(4), 2):
            both = np.array([(r[1][i], r[1][j]) for r in rows if r[0] == s and r[1] is not None and len(r[1]) > j])
            if len(both):
                d = both - both[0]
                want[s, i, j] = (len(both), float(np.mean((d[:, 0] - d[:, 0].mean()) * (d[:, 1] - d[:, 1].mean()))))
    assert got.keys() == want.keys() and got[7, 0, 0][1] == pytest.approx(0.25, abs=1e-9)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_the_verdicts_vectors(spark):
    rows = [(1, [1.0, 5.0]), (1, [2.0, 7.0]), (1, [3.0]), (1, [4.0, 8.0])]
    want = np.cov(np.array([(1, 5), (2, 7), (4, 8)], float).T, bias=True)[0, 1]
    assert all(cov_of(spark, rows, n)[1, 0, 1] == (3, pytest.approx(want)) for n in (1, 4))


def test_running_moments_are_the_batchs():
    x = np.random.default_rng(5).normal(size=(60, 3)) + 1e6
    m = moments.RunningMoments()
    for a in range(0, 60, 7):
        m.add(pd.Series(x[a : a + 7].tolist()))
    got = {(r.i, r.j): r.cov for r in m.rows().itertuples()}
    want = np.cov(x.T, bias=True)
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-8) for i, j in got) and len(got) == 6


GATES = tuple(OnsetParams(m, threshold=0.5, refractory=2, warmup=4, smooth_window=2, odf_window=8) for m in ("hfc", "flux", "flux", "hfc", "rms"))
CUTTER = CutterParams(128, 64, 44100.0, silent_frames="noise", chunk_size=100)


def live_source(spark):
    rng = np.random.default_rng(12)
    rows = []
    for s in (1, 2):
        loud = np.repeat(rng.random(60) < 0.3, 128)
        rows += [(s, i, c) for _, i, c in chunked(rng.normal(size=60 * 128) * (0.02 + loud), (100,))]
    return spark.createDataFrame(rows, "stream_id long, frame_idx long, samples array<double>")


def test_live_graph_is_the_chain_of_its_operators(spark):
    from pulsegrid.functions import arrays
    from pulsegrid.operators import dsp
    from pulsegrid.params import MaskParams

    src = live_source(spark)
    p = PredictorParams(44100.0, 64, warmup_hits=3, max_bpm=60_000.0)
    g = graph.live_graph(CUTTER, GATES, predict=p)
    out = g.build(src, ("pack.gates", "instruments.sums", "predictor.predictions"))
    cut_frames = frames.chunk_frames(src.withColumnRenamed("frame_idx", "chunk_idx"), CUTTER)
    sums = dsp.mel_bands(dsp.spectrum(dsp.windowed(cut_frames, 128))).select("stream_id", "frame_idx", arrays.instrument_sum(F.col("bands"), MaskParams()).alias("s"))
    alone = [gates.onset_gate(sums.select("stream_id", "frame_idx", F.get("s", F.lit(i)).alias("x")), q).select("stream_id", "frame_idx", F.col("hit").cast("double").alias(f"g{i}")) for i, q in enumerate(GATES)]
    zipped = alone[0]
    for part in alone[1:]:
        zipped = zipped.join(part, ["stream_id", "frame_idx"])
    packed = zipped.select("stream_id", "frame_idx", F.array(*[f"g{i}" for i in range(5)]).alias("gates"))
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert rows(out["pack.gates"]) == rows(packed) and packed.where("exists(gates, x -> x > 0)").count() > 5
    assert rows(out["predictor.predictions"]) == rows(tracking.instrument_predictor(packed, p).select("stream_id", "frame_idx", "predictions"))
    assert sorted(r[2] for r in out["instruments.sums"].collect()) == sorted(r[2] for r in sums.collect())


def test_graph_reads_its_source_once(spark, tmp_path):
    path = str(tmp_path / "src")
    live_source(spark).write.parquet(path)
    src = spark.read.parquet(path)
    g = graph.live_graph(CUTTER, GATES)
    plan = g.build(src, ("pack.gates",))["pack.gates"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Join" not in plan
    seen = {}
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    tapped = src.mapInPandas(counted, src.schema)
    g.run(tapped, {p: (lambda df, p=p: seen.update({p: df.count()})) for p in ("kick_gate.value", "ohc_sum.value", "predictor.predictions", "lighting.command")})
    assert seen["kick_gate.value"] == seen["ohc_sum.value"] > 100 and reads.value == src.count()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_graph_is_checked(spark):
    op = graph.column_operator(("a",), "b", lambda a: a)
    with pytest.raises(ValueError, match="circle"):
        graph.Graph(("s",)).add("x", op, a="y.b").add("y", op, a="x.b").order()
    with pytest.raises(ValueError, match="inputs"):
        graph.Graph(("s",)).add("x", op, c="s")
    with pytest.raises(ValueError, match="already"):
        graph.Graph(("s",)).add("x", op, a="s").add("x", op, a="s")
    with pytest.raises(ValueError, match="unknown"):
        graph.Graph(("s",)).add("x", op, a="s").build(spark.range(1).selectExpr("id as stream_id", "id as frame_idx", "id as s"), ("z.b",))


def test_ports_on_different_rows_meet(spark):
    """A node that reads ports of thinned and whole rows gets the rows of both."""
    thin = graph.Operator(("a",), ("b",), lambda df, c, n: df.where("frame_idx % 2 = 0").select("stream_id", "frame_idx", F.col(c["a"]).alias(n["b"])), new_rows=True)
    add = graph.column_operator(("l", "r"), "sum", lambda a, b: a + b)
    g = graph.Graph(("s",)).add("thin", thin, a="s").add("twice", graph.column_operator(("a",), "b", lambda a: a * 2), a="s").add("sum", add, l="thin.b", r="twice.b")
    rows = spark.range(6).selectExpr("1L as stream_id", "id as frame_idx", "id as s")
    assert sorted((r[1], r[2]) for r in g.build(rows, ("sum.sum",))["sum.sum"].collect()) == [(0, 0), (2, 6), (4, 12)]


def test_front_end_in_one_pass(spark):
    """Spectra, bands and cepstra together are those of numpy row by row; null and empty frames give empty ones; one Python step."""
    rng = np.random.default_rng(3)
    given = [rng.random(128).tolist(), None, [], rng.random(64).tolist(), [0.0] * 128, rng.random(128).tolist()]
    df = spark.createDataFrame(list(enumerate(given)), "frame_idx long, frame array<double>").coalesce(1)
    made = dsp.front(df, 20, 44100.0)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for i, spec, bands, cep in made.select("frame_idx", "spectrum", "bands", "mfcc").collect():
        if not given[i]:
            assert spec == bands == cep == []
            continue
        want = np.abs(np.fft.rfft(given[i]))
        band = dsp.mel_filters(20, len(want), 44100.0) @ want**2
        basis = np.cos(np.pi * np.arange(13)[:, None] * (2 * np.arange(20) + 1) / 40) * np.sqrt(2 / 20) / np.where(np.arange(13) == 0, np.sqrt(2), 1)[:, None]
        assert np.allclose(spec, want, rtol=1e-12, atol=1e-12) and np.allclose(bands, band, rtol=1e-12, atol=1e-12)
        assert np.allclose(cep, basis @ (10 * np.log10(np.maximum(1e-10, band))), rtol=1e-9, atol=1e-9)
    assert dsp.mel_bands(dsp.spectrum(df), 20).where("size(bands) = 20").count() == 4


def test_scans_of_a_graph_carry_only_what_is_read(spark, monkeypatch):
    """The gates' scan gets sums; frames, spectra and bands, which nothing reads behind it, stay out of Python."""
    seen, real = [], graph.ordered_scan
    monkeypatch.setattr(graph, "ordered_scan", lambda rows, *a: seen.append(rows.schema) or real(rows, *a))
    rows = spark.createDataFrame([(1, 0, [0.5] * 64)], "stream_id long, frame_idx long, samples array<double>")
    ports = graph.live_graph().build(rows, ("pack.gates", "instruments.sums"))
    assert [f.name for f in seen[0]["_kept"].dataType] == ["instruments_sums"]
    assert {p: set(df.columns) for p, df in ports.items()} == {"pack.gates": {"stream_id", "frame_idx", "pack_gates"}, "instruments.sums": {"stream_id", "frame_idx", "instruments_sums"}}
