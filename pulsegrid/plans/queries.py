"""Queries by name: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from ..operators import aggregates, beats, device, dsp, gates, lighting, tracking
from ..params import INSTRUMENTS, BufferParams, LightingParams, MultiFrameParams, OnsetParams, OnsetVectorParams, PredictorParams, QuantileParams, QueueParams
from ..sources import channels, messages
from ..sources.tables import band_frames, cut_frames, event_frames, gate_frames, read, sine

HOP, RATE = 4096, 40960.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    return F.round(c, 6)


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a hit of its instrument at frame time."""
    return event_frames(spark, sf_dir).select("stream_id", "instrument", "frame_idx", F.round(S.audio_time(F.col("frame_idx"), HOP, RATE), 6).alias("t"), "x", "ts")


def forecast_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.simple_forecast(tracking.hit_intervals(hits_of(spark, sf_dir)))


def cents(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: F.round(x * 100).cast("long").cast("string")), ",")


@query
def onset_counts(spark, sf_dir):
    """How many onsets the adaptive gate finds in each stream."""
    out = gates.onset_gate(event_frames(spark, sf_dir), OnsetParams("rms", threshold=1.4, refractory=4, warmup=8, smooth_window=2, odf_window=64))
    return out.groupBy("stream_id").agg(F.sum("hit").cast("long").alias("n_hits"), F.count(F.lit(1)).alias("n_frames"))


@query
def vector_index(spark, sf_dir):
    v = F.col("bands")
    return band_frames(spark, sf_dir).select("vec_id", r6(A.vector_index(v, -2)).alias("below"), r6(A.vector_index(v, 3)).alias("inside"), r6(A.vector_index(v, 99)).alias("beyond"))


@query
def sum_range(spark, sf_dir):
    v = F.col("bands")
    return band_frames(spark, sf_dir).select("vec_id", r6(A.sum_range(v, 1, 10)).alias("inside"), r6(A.sum_range(v, 60, 99)).alias("clamped"), r6(A.sum_range(v, 5, 2)).alias("empty"))


@query
def instrument_sum(spark, sf_dir):
    sums = band_frames(spark, sf_dir).select("vec_id", A.instrument_sum(F.col("bands")).alias("s"))
    return sums.select("vec_id", *[r6(F.get("s", F.lit(i))).alias(n) for i, n in enumerate(INSTRUMENTS)])


@query
def vector_pack5(spark, sf_dir):
    """Gate streams of the five instruments zipped into one row a frame: missing values are 0."""
    long = event_frames(spark, sf_dir).select("stream_id", "frame_idx", "instrument", F.lit(1.0).alias("g"))
    packed = long.groupBy("stream_id", "frame_idx").agg(*[F.coalesce(F.max(F.when(F.col("instrument") == n, F.col("g"))), F.lit(0.0)).alias(n) for n in INSTRUMENTS])
    v = A.pack5(*map(F.col, INSTRUMENTS))
    return packed.select("stream_id", "frame_idx", *INSTRUMENTS, A.any_hit(v).alias("any_hit"))


@query
def instrument_map(spark, sf_dir):
    """Names, indices and colours of the events' instruments."""
    c = S.colour(F.col("instrument"))
    index = S.instrument_index(F.col("instrument"))
    return event_frames(spark, sf_dir).select("event_id", "instrument", index.alias("idx"), S.instrument_name(index).alias("back"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), S.feature_index(F.concat(F.lit("gate."), F.col("instrument"))).alias("feature_idx"), S.feature_index(F.concat(F.lit("gate."), F.col("event_type"))).alias("unknown"))


@query
def silence_gate(spark, sf_dir):
    chunks = band_frames(spark, sf_dir).select("stream_id", F.col("frame_idx").alias("chunk_idx"), F.col("bands").alias("samples"))
    return aggregates.silence_gate(chunks, least=0.125).select("stream_id", "chunk_idx", r6("rms").alias("rms"))


@query
def threshold_filter(spark, sf_dir):
    modes = {m: aggregates.passes(F.col("x"), BufferParams(threshold=50.0, threshold_mode=m)) for m in ("always", "above", "below")}
    return event_frames(spark, sf_dir).groupBy("stream_id").agg(*[F.count(F.when(c, 1)).alias(m) for m, c in modes.items()])


@query
def hit_filter(spark, sf_dir):
    long = gate_frames(spark, sf_dir).select("stream_id", "frame_idx", F.posexplode("gates").alias("i", "value"))
    return long.where("value >= 0.5").select("stream_id", "frame_idx", S.instrument_name(F.col("i")).alias("instrument"), "value")


def features_of(spark, sf_dir):
    return event_frames(spark, sf_dir).select("stream_id", "frame_idx", F.concat(F.lit("gate."), F.col("instrument")).alias("feature"), F.col("x").alias("value"))


@query
def pool_stats(spark, sf_dir):
    s = aggregates.pool_stats(features_of(spark, sf_dir))
    return s.select("stream_id", "feature", "n", *[r6(c).alias(c) for c in ("mean", "var", "var_samp", "min", "max")])


@query
def frame_arrays(spark, sf_dir):
    return aggregates.frame_arrays(features_of(spark, sf_dir)).select("stream_id", "feature", cents("frames").alias("frames"))


@query
def band_covariance(spark, sf_dir):
    return aggregates.covariance(band_frames(spark, sf_dir)).select("stream_id", "i", "j", (r6("cov") + 0.0).alias("cov"))


@query
def inverse_covariance(spark, sf_dir):
    return aggregates.inverse_covariance(band_frames(spark, sf_dir)).select("stream_id", "i", "j", r6("icov").alias("icov"))


@query
def running_median_mad(spark, sf_dir):
    return aggregates.running_median_mad(event_frames(spark, sf_dir), 16).select("stream_id", "frame_idx", r6("median").alias("median"), r6("mad").alias("mad"))


@query
def running_quantiles(spark, sf_dir):
    return aggregates.running_quantiles(event_frames(spark, sf_dir)).select("stream_id", "frame_idx", r6("hi").alias("hi"), r6("lo").alias("lo"))


ONSETS = {
    "onset_gate_rms": OnsetParams("rms", threshold=1.4, refractory=4, warmup=8, smooth_window=2, odf_window=16),
    "onset_gate_hfc": OnsetParams("hfc", threshold=1.4, refractory=4, warmup=8, smooth_window=2, odf_window=32),
    "onset_gate_flux": OnsetParams("flux", threshold=0.5, refractory=3, warmup=4, smooth_window=2, odf_window=16),
    "onset_gate_default": OnsetParams("complex", threshold=1.0, refractory=6, warmup=10, smooth_window=2, odf_window=64),
}


def _onset(name: str):
    def run(spark, sf_dir):
        out = gates.onset_gate(event_frames(spark, sf_dir), ONSETS[name])
        return out.select("stream_id", "frame_idx", r6("odf").alias("odf"), r6("threshold").alias("threshold"), "hit")

    run.__name__ = name
    return query(run)


for _name in ONSETS:
    _onset(_name)

VECTOR = OnsetVectorParams("hfc", threshold=1.0, refractory=3, warmup=6, smooth_window=2, odf_window=16)


@query
def onset_gate_vector(spark, sf_dir):
    out = gates.onset_gate_vector(band_frames(spark, sf_dir), VECTOR)
    return out.select("stream_id", "frame_idx", "band", "hit")


def _multi(mode: str):
    def run(spark, sf_dir):
        out = gates.multiframe_gate(event_frames(spark, sf_dir), multi_params(mode))
        return out.select("stream_id", "frame_idx", "hit")

    run.__name__ = f"multiframe_{mode}"
    return query(run)


def multi_params(mode: str) -> MultiFrameParams:
    return MultiFrameParams(window_size=8, peak_threshold=1.2, trend_threshold=1.3, variance_threshold=1.5, refractory=3, warmup=10, detection_mode=mode)


for _mode in ("peak", "trend", "variance", "combined"):
    _multi(_mode)

QUANTILE = QuantileParams(refractory=4, warmup=10)


@query
def quantile_gate(spark, sf_dir):
    return gates.quantile_gate(event_frames(spark, sf_dir), QUANTILE).select("stream_id", "frame_idx", "hit")


@query
def refractory(spark, sf_dir):
    return gates.refractory(event_frames(spark, sf_dir).withColumn("candidate", (F.col("x") > 30).cast("int")), 4).select("stream_id", "frame_idx", "hit")


@query
def ioi_stats(spark, sf_dir):
    out = tracking.hit_intervals(hits_of(spark, sf_dir))
    return out.select("stream_id", "instrument", "frame_idx", "gap", "n_recent", "n_valid", r6("period_median").alias("period_median"), r6("period_mad").alias("period_mad"))


def beats_of(spark, sf_dir):
    return hits_of(spark, sf_dir).where("instrument = 'kick'").select("stream_id", "frame_idx", "t")


@query
def beat_kalman(spark, sf_dir):
    return tracking.beat_kalman(beats_of(spark, sf_dir)).select("stream_id", "frame_idx", r6("phase").alias("phase"), r6("period").alias("period"), r6("std").alias("std"))


@query
def beat_forecast(spark, sf_dir):
    last = beats_of(spark, sf_dir).groupBy("stream_id").agg(F.min("t").alias("phase"), F.max("t").alias("now"))
    return last.select("stream_id", F.posexplode(S.beat_forecast(F.col("now") + 0.01, F.col("phase"), F.lit(0.5), 4)).alias("k", "t")).select("stream_id", "k", r6("t").alias("t"))


@query
def clock_offset(spark, sf_dir):
    samples = hits_of(spark, sf_dir).withColumn("wall", F.col("t") + F.col("x") / 1000)
    return tracking.clock_offset(samples).select("stream_id", "frame_idx", r6("clock_offset").alias("clock_offset"))


BUFFER = BufferParams(buffer_size=5, threshold=20.0, threshold_mode="above")


@query
def buffered_messages(spark, sf_dir):
    out = aggregates.buffered_messages(event_frames(spark, sf_dir), "gate.kick", BUFFER)
    return out.select("stream_id", "message_no", "feature_name", "frame_count", cents("values").alias("values"))


@query
def hit_ratio(spark, sf_dir):
    v = F.transform("bands", lambda x: F.abs(x) * 4)
    strict, loose = A.hit_ratio(v, 0.5, True), A.hit_ratio(v, 0.5, False)
    return band_frames(spark, sf_dir).select("vec_id", strict["hits"].alias("hits"), strict["n"].alias("n"), r6(strict["percentage"]).alias("percentage"), loose["hits"].alias("loose_hits"), cents_slice("bands").alias("first_five"))


def cents_slice(column: str) -> F.Column:
    return F.array_join(F.transform(F.slice(column, 1, 5), lambda x: F.floor(x * 1000).cast("string")), ",")


@query
def trailing_rate(spark, sf_dir):
    hits = hits_of(spark, sf_dir).withColumn("t_us", F.col("frame_idx") * 100_000)
    return aggregates.trailing_rate(hits, 2).select("stream_id", "instrument", "t_us", "total", "recent", r6("rate").alias("rate"))


@query
def prediction_counts(spark, sf_dir):
    return forecast_of(spark, sf_dir).groupBy("stream_id", "instrument").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("frame_idx").alias("n_messages"))


@query
def predictions_flat(spark, sf_dir):
    f = forecast_of(spark, sf_dir)
    return f.select("stream_id", "instrument", "frame_idx", "hit_index", *[r6(c).alias(c) for c in ("now", "t_pred_sec", "ci_low_sec", "ci_high_sec", "confidence")])


LIGHTS = LightingParams(confidence_threshold=0.3, min_latency=0.07, max_latency=2.0)


@query
def confidence_filter(spark, sf_dir):
    return lighting.confident(forecast_of(spark, sf_dir), 0.5).groupBy("stream_id", "instrument").agg(F.count(F.lit(1)).alias("n"))


@query
def latency_filter(spark, sf_dir):
    return lighting.in_time(forecast_of(spark, sf_dir), 0.5, 1.5).groupBy("stream_id", "instrument").agg(F.count(F.lit(1)).alias("n"))


@query
def event_dedup(spark, sf_dir):
    return lighting.first_of_each_event(forecast_of(spark, sf_dir)).select("stream_id", "event_id", "frame_idx", "hit_index")


@query
def lighting_commands(spark, sf_dir):
    return lighting.commands(forecast_of(spark, sf_dir), LIGHTS).select("stream_id", "frame_idx", "instrument", r6("t_pred_sec").alias("t_pred_sec"), r6("confidence").alias("confidence"), "r", "g", "b", "event_id")


@query
def unix_events(spark, sf_dir):
    out = lighting.unix_events(lighting.commands(forecast_of(spark, sf_dir), LIGHTS), 100, 900_000)
    return out.select("stream_id", "event_id", "unix_time", "microseconds", "r", "g", "b")


@query
def nearest_discard(spark, sf_dir):
    new = forecast_of(spark, sf_dir).select("stream_id", "instrument", "hit_index", "frame_idx", r6("t_pred_sec").alias("t_pred_sec")).withColumn("seq", F.col("frame_idx"))
    return lighting.nearest_discard(new).select("stream_id", "instrument", "hit_index", "frame_idx", "t_pred_sec")


def hit_log_of(spark, sf_dir):
    return messages.hit_log(hits_of(spark, sf_dir).select("stream_id", "frame_idx", "instrument", F.lit(1.0).alias("value")), HOP, RATE)


@query
def hit_log(spark, sf_dir):
    return hit_log_of(spark, sf_dir)


@query
def prediction_log(spark, sf_dir):
    return messages.prediction_log(forecast_of(spark, sf_dir))


@query
def log_union(spark, sf_dir):
    both = messages.log_union(hit_log_of(spark, sf_dir), messages.prediction_log(forecast_of(spark, sf_dir)))
    return both.groupBy("stream_id", "type", "instrument").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), F.count("predicted_time").alias("n_predicted"))


@query
def prediction_accuracy(spark, sf_dir):
    out = aggregates.accuracy(forecast_of(spark, sf_dir), hits_of(spark, sf_dir))
    return out.select("stream_id", "instrument", "frame_idx", "hit_index", r6("next_hit").alias("next_hit"), r6("last_hit").alias("last_hit"), "in_interval", "abs_error")


def arrivals_of(spark, sf_dir):
    """Events as device events: due up to 9 seconds after arrival."""
    e = event_frames(spark, sf_dir)
    c = S.colour(F.col("instrument"))
    arrival = F.col("frame_idx") * 100_000
    return e.select("stream_id", arrival.alias("arrival_us"), F.col("frame_idx").alias("seq"), (arrival + F.pmod(F.col("event_id") * 7919, F.lit(90)) * 100_000).alias("execute_time_us"), (c["r"] == 1).alias("red"), (c["g"] == 1).alias("green"), (c["b"] == 1).alias("blue"), F.col("event_id").cast("int").alias("event_id"))


@query
def due_order(spark, sf_dir):
    return device.due_order(arrivals_of(spark, sf_dir)).select("stream_id", "event_id", "execute_time_us", "position")


@query
def led_timeline(spark, sf_dir):
    return device.led_timeline(arrivals_of(spark, sf_dir))


@query
def device_queue(spark, sf_dir):
    return device.device_queue(arrivals_of(spark, sf_dir))


@query
def scheduled_release(spark, sf_dir):
    return device.scheduled_release(forecast_of(spark, sf_dir).withColumn("t_pred_sec", r6("t_pred_sec")))


@query
def visual_intervals(spark, sf_dir):
    return device.visual_intervals(hits_of(spark, sf_dir))


@query
def trajectory(spark, sf_dir):
    moves = event_frames(spark, sf_dir).groupBy("stream_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"))
    moves = moves.select(F.col("stream_id").alias("move_id"), "x0", "x1", F.lit(0.0).alias("t0"), (F.col("n") * 0.1).alias("t1"))
    return aggregates.trajectory(moves).select("move_id", "step", r6("position").alias("position"), r6("time").alias("time"))


@query
def json_defaults(spark, sf_dir):
    p = F.col("props")
    return event_frames(spark, sf_dir).select("event_id", S.json_field(p, "k", "int", -1).alias("k"), S.json_field(p, "missing", "int", 7).alias("missing"))


@query
def batch_envelope(spark, sf_dir):
    """Odd users send each event alone, even ones all of a frame's decade in one envelope."""
    e = event_frames(spark, sf_dir)
    body = F.to_json(F.struct(F.col("frame_idx").alias("unix_time"), (F.col("event_id") % 3).cast("int").alias("r"), F.pmod("event_id", F.lit(256)).alias("event_id")))
    rows = e.select("stream_id", "frame_idx", body.alias("payload"))
    alone = rows.where("stream_id % 2 = 1").select("stream_id", F.col("frame_idx").alias("message"), "payload")
    packed = rows.where("stream_id % 2 = 0").groupBy("stream_id", (F.col("frame_idx") - F.col("frame_idx") % 10).alias("message")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "payload"))).alias("e"))
    packed = packed.select("stream_id", "message", F.concat(F.lit('{"events":['), F.array_join(F.transform("e", lambda x: x["payload"]), ","), F.lit('],"batch_id":1}')).alias("payload"))
    return messages.enveloped(alone.unionByName(packed)).select("stream_id", "message", "unix_time", "microseconds", "r", "g", "b", "event_id")


@query
def message_routing(spark, sf_dir):
    """Gate messages, prediction messages and broken texts on one channel."""
    e = event_frames(spark, sf_dir)
    text = F.when(F.col("event_type") == "error", F.lit("{broken")).when(F.col("event_type") == "view", F.to_json(F.struct(F.col("frame_idx"), F.array().cast("array<string>").alias("predictions")))).otherwise(F.to_json(F.struct(F.concat(F.lit("gate."), F.col("instrument")).alias("feature_name"), F.col("frame_idx").alias("frame_count"), F.array("x").alias("values"))))
    g, p = messages.routed(e.select("stream_id", text.alias("payload")))
    a = g.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_count").alias("frames"), F.count("feature_name").alias("named")).withColumn("channel", F.lit("gates"))
    b = p.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_idx").alias("frames"), F.lit(0).cast("long").alias("named")).withColumn("channel", F.lit("predictions"))
    return a.unionByName(b)


@query
def run_summary(spark, sf_dir):
    out = aggregates.run_summary(event_frames(spark, sf_dir))
    return out.select("stream_id", r6("seconds").alias("seconds"), "frames", F.round("fps", 9).alias("fps"))


@query
def beat_dedup(spark, sf_dir):
    """First beat of each time rounded to hundredths (half to even) and type."""
    b = forecast_of(spark, sf_dir).select("stream_id", r6("t_pred_sec").alias("t"), F.col("hit_index").alias("event_type"), "frame_idx")
    return beats.first_of_each_beat(b)


@query
def beat_log(spark, sf_dir):
    b = forecast_of(spark, sf_dir).where("hit_index = 1").select("stream_id", "instrument", "frame_idx", r6("now").alias("t"), F.array(r6("t_pred_sec")).alias("p"))
    std = F.lit(0.0125)
    return b.select("stream_id", "instrument", "frame_idx", messages.beat_log_line(F.col("t"), F.col("p"), std).alias("line"), messages.beat_csv(F.col("t"), F.col("p"), std).alias("csv"))


@query
def beat_log_formats(spark, sf_dir):
    """The logger's detailed, simple and csv lines of every beat with its next four."""
    b = tracking.simple_forecast(tracking.hit_intervals(hits_of(spark, sf_dir)), 4).groupBy("stream_id", "instrument", "frame_idx").agg(F.first("now").alias("t"), F.array_sort(F.collect_list(r6("t_pred_sec"))).alias("p"))
    p, std = F.transform("p", lambda x: F.round(x - r6("t"), 6)), F.lit(0.0125)
    return b.select("stream_id", "instrument", "frame_idx", *[messages.beat_line(r6("t"), p, std, f).alias(f) for f in ("detailed", "simple", "csv")])


@query
def beat_intervals(spark, sf_dir):
    """Intervals between kicks, their guard, counter and the last eight valid ones."""
    out = beats.intervals(beats_of(spark, sf_dir))
    return out.select("stream_id", "frame_idx", "beat_no", "ibi", "ibi_valid", F.array_join(F.transform("recent_ibis", lambda x: F.round(x * 10).cast("long").cast("string")), ",").alias("recent_ibis"))


@query
def delayed_shows(spark, sf_dir):
    """The first two forecast beats that are still to come half a second later."""
    f = forecast_of(spark, sf_dir).groupBy("stream_id", "instrument", "frame_idx", "now").agg(F.array_sort(F.collect_list(r6("t_pred_sec"))).alias("predicted"))
    out = beats.delayed_shows(f.select(F.concat_ws("/", "stream_id", "instrument", "frame_idx").alias("stream_id"), (F.col("now") + 0.5).alias("now"), "predicted"))
    return out.select(F.col("stream_id").alias("beat"), "index", "show_at", r6("delay").alias("delay"))


@query
def bounded_queues(spark, sf_dir):
    """Events that bounded queues of each stream and ten-frame trigger leave: drop newest, drop oldest, keep the latest."""
    e = event_frames(spark, sf_dir).select("stream_id", F.expr("frame_idx div 10").alias("trigger"), "frame_idx", "event_id")
    kept = lambda df, policy: df.select("stream_id", "trigger", "frame_idx", "event_id", F.lit(policy).alias("policy"))
    newest, oldest = (beats.bounded(e, ["stream_id", "trigger"], "frame_idx", 3, d) for d in ("newest", "oldest"))
    return kept(newest, "drop_newest").unionByName(kept(oldest, "drop_oldest")).unionByName(kept(beats.keep_latest(e, ["stream_id"], "trigger", "frame_idx"), "keep_latest"))


@query
def event_patterns(spark, sf_dir):
    """The beat pattern and the colour pattern, shifted to a start a nation."""
    start = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("run"))
    both = beats.beat_pattern(spark, 1_700_000_012.25).unionByName(beats.colour_pattern(spark, 1_700_000_020.0))
    sec, us = beats.relative_time(F.col("unix_time"), F.col("microseconds"), F.col("run") * 0.3)
    return start.join(F.broadcast(both)).select("run", "event_id", sec.alias("unix_time"), us.alias("microseconds"), "r", "g", "b")


@query
def prediction_payloads(spark, sf_dir):
    """Predictor outputs as JSON texts with six digits: sizes, and what reading them back gives."""
    out = tracking.instrument_predictor(gate_frames(spark, sf_dir), PREDICTOR)
    texts = channels.prediction_payloads(out).select("topic", "payload")
    back = channels.prediction_stream(texts).select("timestamp_sec", "frame_idx", F.explode("predictions").alias("p"))
    return back.select("frame_idx", r6("timestamp_sec").alias("now"), "p.instrument", r6("p.period_sec").alias("period_sec"), r6("p.phase").alias("phase"), "p.warmup_complete", F.size("p.hits").alias("n_hits"))


@query
def canvas_places(spark, sf_dir):
    """Where hits and forecasts are drawn, in rows and in columns."""
    f = forecast_of(spark, sf_dir)
    i = S.instrument_index(F.col("instrument"))
    out = f.select("stream_id", "instrument", "frame_idx", "hit_index", *[S.place(i, F.col("hit_index"), 1200, 700, layout)[k].alias(f"{layout}_{k}") for layout in ("horizontal", "vertical") for k in "xy"])
    return out.withColumn("feature_kept", S.is_gate(F.concat(F.lit("gate."), F.col("instrument"))) & ~S.is_gate(F.col("instrument")))


@query
def scalar_functions(spark, sf_dir):
    x, k = F.col("x"), F.col("frame_idx")
    j = S.min_jerk(F.lit(0.0), F.lit(2.0), F.lit(1.0), x / 1000)
    return event_frames(spark, sf_dir).select(
        "event_id", r6(S.hz_to_mel(x)).alias("mel"), r6(S.mel_to_hz(x)).alias("hz"), S.clamp(x, 10.0, 90.0).alias("clamped"), r6(S.wrap_unit(x / 7)).alias("unit"), r6(S.wrap_half(x / 7)).alias("half"),
        r6(S.lobe_weight(x, 20.0, 80.0, 0.7, 0.15)).alias("lobe"), r6(S.audio_time(k)).alias("audio_time"), r6(j["velocity"]).alias("velocity"), r6(j["acceleration"]).alias("acceleration"), r6(j["jerk"]).alias("jerk"),
        S.tick_us(k, k * 10, F.lit(5), F.lit(250), F.lit(1_000_000)).alias("tick"), S.lane(S.instrument_index(F.col("instrument")), 1000).alias("lane"), S.log_file_name("beats_", F.col("ts"), ".log").alias("log_file"),
        S.ntp_offset(k * 10, k * 3).alias("ntp_offset"), S.query_flag(F.concat(F.lit("/led?r="), (k % 2).cast("string"), F.lit("&g=1")), "r").alias("flag"), F.unix_millis(S.ms_to_timestamp(k * 1001)).alias("ms"),
    )


@query
def time_windows(spark, sf_dir):
    """Hits and energy in sliding windows of event time."""
    w = event_frames(spark, sf_dir).groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour"), "instrument").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.round(F.col("x") * 100).cast("long")).alias("energy_cents"))
    return w.select(F.unix_seconds(F.col("window.start")).alias("start"), "instrument", "hits", "energy_cents")


@query
def sine_frames(spark, sf_dir):
    """A 440 Hz sine cut into overlapping frames: sum of squares of each, windowed and not."""
    chunk = sine(spark, 4096).groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "sample"))), lambda s: s["sample"]).alias("samples"))
    cut = cut_frames(chunk, 1024, 256)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    soft = dsp.windowed(cut.withColumn("plain", square("frame")), 1024)
    return soft.select("frame_idx", r6("plain").alias("energy"), F.round(square("frame") * 1e6, 4).alias("windowed_energy"))


@query
def spectral_peak(spark, sf_dir):
    """Strongest bin, strongest mel band and first cepstral term of the sine's frames."""
    chunk = sine(spark, 4096).groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "sample"))), lambda s: s["sample"]).alias("samples"))
    spec = dsp.spectrum(dsp.windowed(cut_frames(chunk, 1024, 256), 1024))
    peak = (F.array_position("spectrum", F.array_max("spectrum")) - 1).alias("peak_bin")
    cep = dsp.mfcc(dsp.mel_bands(spec.withColumn("peak_bin", peak)))
    top = F.array_max("bands")
    return cep.select("frame_idx", "peak_bin", (F.array_position("bands", top) - 1).alias("peak_band"), F.size("mfcc").alias("n_mfcc"), F.round(top, 9).alias("top_band"), F.round(F.get("mfcc", F.lit(0)), 4).alias("c0"), F.round(F.get("mfcc", F.lit(1)), 4).alias("c1"))


@query
def test_patterns(spark, sf_dir):
    """Timed test events: i-th at half a second each, colours in turn; as many as there are regions."""
    n = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("i"))
    i = F.col("i")
    sec, us = S.unix_split(F.lit(1_700_000_000), F.lit(0), i * 0.5)
    return n.select(i.alias("event_id"), sec.alias("unix_time"), us.alias("microseconds"), (i % 3 == 0).cast("int").alias("r"), (i % 3 == 1).cast("int").alias("g"), (i % 3 == 2).cast("int").alias("b"))


PREDICTOR = PredictorParams(sample_rate=RATE, hop_size=HOP)


@query
def instrument_predictor(spark, sf_dir):
    """Flattened forecasts of the five trackers."""
    out = lighting.flatten(tracking.instrument_predictor(gate_frames(spark, sf_dir), PREDICTOR))
    return out.select("stream_id", "frame_idx", "instrument", "hit_index", *[r6(c).alias(c) for c in ("now", "t_pred_sec", "ci_low_sec", "ci_high_sec", "confidence")])


@query
def predictor_states(spark, sf_dir):
    out = tracking.instrument_predictor(gate_frames(spark, sf_dir), PREDICTOR)
    each = out.select("stream_id", "frame_idx", F.explode("predictions").alias("p"))
    return each.select("stream_id", "frame_idx", "p.instrument", r6("p.tempo_bpm").alias("tempo_bpm"), r6("p.period_sec").alias("period_sec"), r6("p.phase").alias("phase"), "p.warmup_complete", F.size("p.hits").alias("n_hits"))


from . import front  # noqa: E402  (its queries use what stands above)

QUERIES |= front.QUERIES
