"""Channels of messages: streams of JSON texts by topic in, publishers out, over Spark's own file source and sinks.

A channel is a folder of text files below ``topic=<name>``. Each micro-batch owns one folder; one that was written to its end is never
written again, so a batch that is retried then doubles nothing, whether readers have been there or not. A batch that failed half-way is
written anew, and readers may have seen some of it: ``sources/exchange.py`` has channels whose readers only see what is committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .messages import GATE_MESSAGE, MQTT_TIME, PREDICTION_MESSAGE, parsed

#: Topics of the device's messages.
SCHEDULE, SINGLE, TIME_SYNC = "beat/events/schedule", "beat/events/single", "beat/time/sync"


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """topic and payload of every message of a channel, as a stream."""
    return spark.readStream.schema("value string, batch long, topic string").option("maxFilesPerTrigger", files_per_trigger).text(path).select("topic", F.col("value").alias("payload"))


def gate_stream(messages: DataFrame) -> DataFrame:
    """Gate messages of a stream or table of (topic, payload): texts without ``predictions``; broken ones are dropped."""
    return parsed(messages.where(F.get_json_object("payload", "$.predictions").isNull()).select("payload"), GATE_MESSAGE)


def prediction_stream(messages: DataFrame) -> DataFrame:
    return parsed(messages.where(F.get_json_object("payload", "$.predictions").isNotNull()).select("payload"), PREDICTION_MESSAGE)


def time_stream(messages: DataFrame) -> DataFrame:
    return parsed(messages.where(F.col("topic") == TIME_SYNC).select("payload"), MQTT_TIME)


def publisher(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that publishes rows of (topic, payload); null payloads are left out."""

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}/_SUCCESS")
        if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return
        rows.where("payload is not null").select(F.col("payload").alias("value"), "topic").write.mode("overwrite").partitionBy("topic").text(f"{path}/batch={batch_id}")

    return write


def gate_payloads(messages: DataFrame, topic: str = "gates") -> DataFrame:
    """(topic, payload) of buffered gate messages (stream_id, feature_name, frame_count, values)."""
    return messages.select(F.lit(topic).alias("topic"), F.to_json(F.struct("feature_name", "frame_count", "values")).alias("payload"))


def prediction_payloads(outputs: DataFrame, topic: str = "predictions") -> DataFrame:
    """(topic, payload) of predictor outputs, numbers with six digits."""
    six = lambda c: F.format_string("%.6f", c)
    pair = lambda name, text: F.concat(F.lit(f'"{name}": '), text)
    obj = lambda *pairs: F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    hit = lambda h: obj(*[pair(n, six(h[n])) for n in ("t_pred_sec", "ci_low_sec", "ci_high_sec", "confidence")], pair("hit_index", h["hit_index"].cast("string")))
    prediction = lambda p: obj(
        pair("instrument", F.concat(F.lit('"'), p["instrument"], F.lit('"'))), *[pair(n, six(p[n])) for n in ("tempo_bpm", "period_sec", "phase", "confidence_global")],
        pair("warmup_complete", p["warmup_complete"].cast("string")), pair("hits", listed(F.transform(p["hits"], hit))),
    )
    payload = obj(pair("timestamp_sec", six(F.col("timestamp_sec"))), pair("frame_idx", F.col("frame_idx").cast("string")), pair("predictions", listed(F.transform("predictions", prediction))))
    # A generator of one row: conditions on a text would write it again for each of them else.
    return outputs.select(F.lit(topic).alias("topic"), F.explode(F.array(payload)).alias("payload"))


def command_payloads(events: DataFrame, topic: str = SINGLE) -> DataFrame:
    """(topic, payload) of Unix events."""
    return events.select(F.lit(topic).alias("topic"), F.to_json(F.struct("unix_time", "microseconds", "confidence", "r", "g", "b", "event_id")).alias("payload"))


def write_aggregates(stats: DataFrame, path: str) -> None:
    """One JSON line a stream and feature with its aggregates and whole frame arrays, partitioned by feature."""
    stats.write.mode("overwrite").partitionBy("feature").json(path)
