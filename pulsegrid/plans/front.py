"""Queries of frames across chunks, segmented scans, quantiles, matches, moments and graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, beats, dsp, frames, graph, matching, moments, quantiles, segments, tracking
from ..params import CutterParams, LightingParams, OnsetParams, PredictorParams
from ..sources import messages
from ..sources.tables import band_frames, event_frames, gate_frames
from . import queries as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
r6 = Q.r6
#: Frames of the front end, longer than the chunks of 64 samples that they are cut from.
FRONT, FRONT_BANDS = CutterParams(128, 96, 44100.0), 20
CUT, NOISY = CutterParams(100, 40), CutterParams(16, 16, silent_frames="noise", seed=7)
TOLERANCE = 0.055


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a chunk of samples of its label's stream."""
    return band_frames(spark, sf_dir).select("stream_id", F.col("frame_idx").alias("chunk_idx"), "vec_id", F.col("bands").alias("samples"))


def energy(column: str) -> F.Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x * x)


@query
def chunk_frames(spark, sf_dir):
    """Frames of 100 samples every 40, cut across chunks of 64."""
    out = frames.chunk_frames(chunks_of(spark, sf_dir), CUT, frames_per_tile=16)
    return out.select("stream_id", "frame_idx", r6(F.get("frame", F.lit(0))).alias("first"), r6(F.get("frame", F.lit(99))).alias("last"), r6(energy("frame")).alias("energy"))


@query
def noise_frames(spark, sf_dir):
    """Every fourth vector is silence: what noise its frames get."""
    c = chunks_of(spark, sf_dir).withColumn("samples", F.when(F.col("vec_id") % 4 == 0, F.transform("samples", lambda x: x * 0)).otherwise(F.col("samples")))
    out = frames.chunk_frames(c, NOISY).withColumn("e", energy("frame"))
    return out.where("e < 1e-6").select("stream_id", "frame_idx", F.round(F.get("frame", F.lit(3)) * 1e9, 3).alias("fourth"), F.round(F.col("e") * 1e12, 3).alias("energy"))


@query
def front_end(spark, sf_dir):
    """Spectrum, mel bands and cepstrum of frames across chunks: strongest bin and band, and the first two cepstral terms."""
    cep = dsp.front(dsp.windowed(frames.chunk_frames(chunks_of(spark, sf_dir), FRONT), FRONT.frame_size), FRONT_BANDS, FRONT.sample_rate)
    peak = (F.array_position("spectrum", F.array_max("spectrum")) - 1).alias("peak_bin")
    top = F.array_max("bands")
    term = lambda i: F.round(F.get("mfcc", F.lit(i)), 4)
    return cep.select("stream_id", "frame_idx", peak, (F.array_position("bands", top) - 1).alias("peak_band"), F.round(top, 9).alias("top_band"), term(0).alias("c0"), term(1).alias("c1"))


@query
def refractory_segments(spark, sf_dir):
    return segments.refractory(event_frames(spark, sf_dir).withColumn("candidate", (F.col("x") > 30).cast("int")), 4, length=16).select("stream_id", "frame_idx", "hit")


@query
def quantile_gate_segments(spark, sf_dir):
    return segments.quantile_gate(event_frames(spark, sf_dir), Q.QUANTILE, length=16).select("stream_id", "frame_idx", "hit")


@query
def clock_offset_segments(spark, sf_dir):
    samples = Q.hits_of(spark, sf_dir).withColumn("wall", F.col("t") + F.col("x") / 1000)
    return segments.clock_offset(samples, length=16).select("stream_id", "frame_idx", r6("clock_offset").alias("clock_offset"))


SEGMENT_ONSET = OnsetParams("hfc", threshold=1.4, refractory=4, warmup=8, smooth_window=2, odf_window=16)


@query
def onset_gate_segments(spark, sf_dir):
    return segments.onset_gate(event_frames(spark, sf_dir), SEGMENT_ONSET, length=24).select("stream_id", "frame_idx", "hit")


@query
def p2_quantiles(spark, sf_dir):
    """The two running quantiles by five moving markers each."""
    return quantiles.running_quantiles(event_frames(spark, sf_dir), exact=False).select("stream_id", "frame_idx", F.round("hi", 9).alias("hi"), F.round("lo", 9).alias("lo"))


@query
def quantile_sketch(spark, sf_dir):
    """Sketches a stream and type merged to one a type: how many values, and whether the median's and the 98th percentile's true ranks are
    within two in a hundred of what was asked for."""
    values = event_frames(spark, sf_dir).select("stream_id", "event_type", F.col("x").alias("value"))
    sketches = quantiles.merged_sketches(quantiles.quantile_sketches(values, ["stream_id", "event_type"]), ["event_type"])
    found = quantiles.sketch_quantiles(sketches, [0.5, 0.98])
    ranks = values.join(F.broadcast(found), "event_type").groupBy("event_type", "n").agg(*[F.avg((F.col("value") <= F.col(q)).cast("double")).alias(q) for q in ("q0", "q1")])
    near = lambda c, q: F.abs(F.col(c) - q) <= 0.02
    return ranks.select("event_type", "n", near("q0", 0.5).alias("median_near"), near("q1", 0.98).alias("high_near"))


def matched_of(spark, sf_dir):
    return matching.matches(Q.forecast_of(spark, sf_dir).withColumn("t_pred_sec", r6("t_pred_sec")), Q.hits_of(spark, sf_dir), TOLERANCE)


@query
def hit_matches(spark, sf_dir):
    """Predictions and hits one to one, those without a partner alone."""
    return matched_of(spark, sf_dir)


@query
def match_report(spark, sf_dir):
    out = matching.match_report(matched_of(spark, sf_dir))
    return out.select("stream_id", "instrument", "n_predictions", "n_hits", "n_pairs", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "mean_error", "mean_abs_error")])


@query
def trailing_predictions(spark, sf_dir):
    """Predicted hits so far and of the last two seconds at every message of an instrument."""
    sent = Q.forecast_of(spark, sf_dir).groupBy("stream_id", "instrument", "frame_idx").agg(F.count(F.lit(1)).alias("n"))
    out = aggregates.trailing_counts(sent.withColumn("t_us", F.col("frame_idx") * 100_000), 2)
    return out.select("stream_id", "instrument", "t_us", "total", "recent", r6("rate").alias("rate"))


@query
def mixed_covariance(spark, sf_dir):
    """Vectors of two to four values far from zero: a pair counts over the rows that hold both."""
    v = band_frames(spark, sf_dir).select("stream_id", F.transform(F.expr("slice(bands, 1, cast(4 - vec_id % 3 as int))"), lambda x: x + 1_000_000).alias("bands"))
    return moments.covariance(v).select("stream_id", "i", "j", "n", (r6("cov") + 0.0).alias("cov"))


@query
def band_precision(spark, sf_dir):
    """Inverse covariance of the first three bands."""
    v = band_frames(spark, sf_dir).select("stream_id", F.slice("bands", 1, 3).alias("bands"))
    return moments.inverse_covariance(v).select("stream_id", "i", "j", (F.round("icov", 5) + 0.0).alias("icov"))


@query
def topic_messages(spark, sf_dir):
    """Messages by topic: schedules, single events and clocks; other topics are dropped."""
    e = event_frames(spark, sf_dir)
    topic = F.when(F.col("event_type") == "click", "beat/events/schedule").when(F.col("event_type") == "view", "beat/time/sync").otherwise("other")
    text = F.when(F.col("event_type") == "click", F.to_json(F.struct(F.col("frame_idx").alias("unix_time"), F.col("event_id").cast("string").alias("event_id")))).otherwise(F.to_json(F.struct(F.col("frame_idx").alias("unix_time"), F.lit("host").alias("sync_source"))))
    found = messages.by_topic(e.select("stream_id", topic.alias("topic"), text.alias("payload")), {"beat/events/schedule": messages.MQTT_EVENT, "beat/time/sync": messages.MQTT_TIME})
    a = found["beat/events/schedule"].groupBy("stream_id").agg(F.count("event_id").alias("n"), F.sum("unix_time").alias("times")).withColumn("topic", F.lit("schedule"))
    b = found["beat/time/sync"].groupBy("stream_id").agg(F.count("sync_source").alias("n"), F.sum("unix_time").alias("times")).withColumn("topic", F.lit("sync"))
    return a.unionByName(b)


@query
def flagged_beats(spark, sf_dir):
    """Rows of time and flag: those that are beats, numbered, and their intervals."""
    rows = Q.hits_of(spark, sf_dir).select("stream_id", "frame_idx", "t", F.when(F.col("instrument") == "kick", 1).otherwise(0).alias("flag"))
    return beats.intervals(beats.beats_only(rows)).select("stream_id", "frame_idx", "beat_no", "ibi")


@query
def last_sync(spark, sf_dir):
    """The newest clock message of every user, arriving in the order of event ids."""
    m = event_frames(spark, sf_dir).where("event_type = 'view'").select(F.col("stream_id").alias("device_id"), F.col("event_id").alias("received_us"), F.col("frame_idx").alias("unix_time"), (F.col("frame_idx") * 7).alias("microseconds"))
    return beats.last_sync(m)


@query
def short_gates(spark, sf_dir):
    """Predictions where every seventh event has only three gates: such frames are skipped and not counted."""
    rows = gate_frames(spark, sf_dir).withColumn("gates", F.when(F.col("event_id") % 7 == 0, F.slice("gates", 1, 3)).otherwise(F.col("gates")))
    out = tracking.instrument_predictor(rows, Q.PREDICTOR).select("stream_id", F.round("timestamp_sec", 6).alias("now"), F.explode("predictions").alias("p"))
    return out.select("stream_id", "now", "p.instrument", F.explode("p.hits").alias("h")).select("stream_id", "now", "instrument", "h.hit_index", r6("h.t_pred_sec").alias("t_pred_sec"), r6("h.confidence").alias("confidence"))


#: The live graph over chunks of 64 samples: gates that warm up within the streams' few hundred frames.
LIVE = CutterParams(128, 32, 44100.0, silent_frames="noise")
LIVE_GATES = tuple(OnsetParams(m, threshold=1.0, refractory=3, warmup=8, smooth_window=2, odf_window=16) for m in ("hfc", "flux", "flux", "hfc", "rms"))


@query
def live_sums(spark, sf_dir):
    """Instrument sums of the live graph, in millionths."""
    sums = graph.live_graph(LIVE, LIVE_GATES).build(chunks_of(spark, sf_dir).withColumnRenamed("chunk_idx", "frame_idx"), ("instruments.sums",))["instruments.sums"]
    return sums.select("stream_id", "frame_idx", *[F.round(F.get("instruments_sums", F.lit(i)) * 1e6, 4).alias(n) for i, n in enumerate(Q.INSTRUMENTS)])


@query
def live_chain(spark, sf_dir):
    """The live graph from samples to light commands: hits, predicted hits and commands of each stream."""
    lights = LightingParams(confidence_threshold=0.3, min_latency=0.0, max_latency=2.0, emit_instruments=tuple(Q.INSTRUMENTS))
    g = graph.live_graph(LIVE, LIVE_GATES, lights, PredictorParams(LIVE.sample_rate, LIVE.hop_size, warmup_hits=3, min_bpm=60.0, max_bpm=100_000.0, periodic_interval=0.001))
    ports = g.build(chunks_of(spark, sf_dir).withColumnRenamed("chunk_idx", "frame_idx"), ("pack.gates", "predictor.predictions", "lighting.command"))
    hits = ports["pack.gates"].groupBy("stream_id").agg(F.sum(F.aggregate("pack_gates", F.lit(0.0), lambda a, x: a + x)).cast("long").alias("n"))
    told = ports["predictor.predictions"].groupBy("stream_id").agg(F.sum(F.aggregate("predictor_predictions", F.lit(0), lambda a, p: a + F.size(p["hits"]))).cast("long").alias("n"))
    sent = ports["lighting.command"].groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    kind = lambda df, name: df.select("stream_id", F.lit(name).alias("kind"), "n")
    return kind(hits, "hits").unionByName(kind(told, "predicted")).unionByName(kind(sent, "commands"))
