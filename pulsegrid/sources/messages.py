"""Messages and logs: parsing with explicit schemas, routing, envelopes, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

GATE_MESSAGE = "feature_name string, timestamp long, frame_count long, values array<double>"
PREDICTION_MESSAGE = "timestamp_sec double, frame_idx long, predictions array<struct<instrument: string, tempo_bpm: double, period_sec: double, phase: double, confidence_global: double, warmup_complete: boolean, hits: array<struct<t_pred_sec: double, ci_low_sec: double, ci_high_sec: double, confidence: double, hit_index: int>>>>"
MQTT_EVENT = "unix_time long, microseconds long, confidence double, r int, g int, b int, event_id string"
MQTT_TIME = "unix_time long, microseconds long, sync_source string"
LOG_LINE = "frame long, audio_time double, wall_time_ms long, wall_time_rel double, type string, instrument string, value double, predicted_time double, confidence double, ci_low double, ci_high double, hit_index int"


def parsed(texts: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    """Fields of JSON texts; texts that are no JSON object are dropped."""
    # A generator of one row: conditions and fields read its result instead of parsing the text again.
    rows = texts.select("*", F.explode(F.array(F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))).alias("_json"))
    whole = F.get_json_object(F.col(column), "$").isNotNull() & F.ltrim(column).startswith("{")
    return rows.where(F.col("_json").isNotNull() & whole).select(*[c for c in texts.columns if c != column], "_json.*")


def routed(texts: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(gate messages, prediction messages) of one channel: what holds ``predictions`` goes to the second."""
    holds = F.get_json_object(F.col(column), "$.predictions").isNotNull()
    return parsed(texts.where(~holds), GATE_MESSAGE, column), parsed(texts.where(holds), PREDICTION_MESSAGE, column)


def by_topic(messages: DataFrame, topics: dict[str, str]) -> dict[str, DataFrame]:
    """Parsed messages of every known topic; other topics are dropped."""
    return {topic: parsed(messages.where(F.col("topic") == topic).drop("topic"), schema) for topic, schema in topics.items()}


def enveloped(texts: DataFrame, column: str = "payload") -> DataFrame:
    """Events of batch envelopes ({"events": [...]}) and of single-event messages, with defaults 0 and "" for missing fields."""
    batch = F.get_json_object(F.col(column), "$.events")
    events = F.when(batch.isNotNull(), F.from_json(batch, "array<string>")).otherwise(F.array(F.col(column)))
    each = texts.select(*[c for c in texts.columns if c != column], F.posexplode(events).alias("position", "_e"))
    field = lambda name, kind, default: S.json_field(F.col("_e"), name, kind, default).alias(name)
    return each.select(*[c for c in texts.columns if c != column], "position", field("unix_time", "long", 0), field("microseconds", "long", 0), field("r", "int", 0), field("g", "int", 0), field("b", "int", 0), field("event_id", "int", 0))


def hit_log(hits: DataFrame, hop: int, sample_rate: float) -> DataFrame:
    """Log rows of gates that fired (>= 0.5)."""
    return hits.where("value >= 0.5").select("stream_id", F.col("frame_idx").alias("frame"), F.round(S.audio_time(F.col("frame_idx"), hop, sample_rate), 6).alias("audio_time"), F.lit("hit").alias("type"), "instrument", "value")


def prediction_log(predictions: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return predictions.select("stream_id", F.col("frame_idx").alias("frame"), r("now").alias("audio_time"), F.lit("prediction").alias("type"), "instrument", r("t_pred_sec").alias("predicted_time"), r("confidence").alias("confidence"), r("ci_low_sec").alias("ci_low"), r("ci_high_sec").alias("ci_high"), "hit_index")


def log_union(hits: DataFrame, predictions: DataFrame) -> DataFrame:
    """Both kinds of log rows in one table."""
    return hits.unionByName(predictions, allowMissingColumns=True)


def write_log(rows: DataFrame, path: str, header: str = "hit and prediction log") -> None:
    """JSON lines; the first line of every file is a comment."""
    lines = rows.select(F.to_json(F.struct(*[c for c in rows.columns])).alias("value"))
    lines.write.text(path + "/lines")
    rows.sparkSession.range(1).select(F.lit(f"# {header}").alias("value")).coalesce(1).write.text(path + "/header")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON-lines logs; lines that start with # and broken lines are dropped."""
    text = spark.read.text(path).where(~F.col("value").startswith("#")).withColumnRenamed("value", "payload")
    return parsed(text, LOG_LINE)


def beat_log_line(t, predicted, std):
    """``beat +0.500s, +1.000s ±12ms``; n/a without predictions."""
    list_ = F.array_join(F.transform(predicted, lambda p: F.concat(F.lit("+"), F.format_string("%.3f", F.round(p - t, 3)), F.lit("s"))), ", ")
    return F.concat(F.format_string("%.3f", t), F.lit(" "), F.when(F.size(predicted) > 0, list_).otherwise(F.lit("n/a")), F.lit(" ±"), F.floor(std * 1000).cast("int").cast("string"), F.lit("ms"))


def beat_csv(t, predicted, std):
    first = F.coalesce(F.format_string("%.6f", F.get(predicted, F.lit(0))), F.lit(""))
    return F.concat_ws(",", F.format_string("%.6f", t), first, F.format_string("%.6f", std))


def beat_line(t, predicted, std, log_format: str = "detailed"):
    """One logger's line of a beat at ``t`` with predicted delays (numbers): detailed, simple or csv; unknown formats count as detailed."""
    if log_format == "simple":
        return F.format_string("BEAT at %.3fs", t)
    if log_format == "csv":
        listed = F.array_join(F.transform(F.slice(predicted, 1, 4), lambda p: F.format_string("%.3f", p)), ",")
        return F.concat_ws(",", F.format_string("%.3f", t), F.format_string("%.1f", std * 1000), F.when(F.size(predicted) > 0, listed).otherwise(F.lit(",,")))
    listed = F.array_join(F.transform(predicted, lambda p: F.format_string("%+.3fs", p)), ", ")
    ahead = F.when(F.size(predicted) > 0, listed).otherwise(F.lit("n/a"))
    return F.concat(F.format_string("BEAT EVENT | Time: %.3fs | Next4: ", t), ahead, F.lit(" (±"), F.floor(std * 1000).cast("int").cast("string"), F.lit("ms)"))


CSV_HEADER = "timestamp,confidence_ms,prediction_1,prediction_2,prediction_3,prediction_4"
