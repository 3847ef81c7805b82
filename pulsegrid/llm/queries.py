"""Queries of the corpus operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, merkle, phrases, reputation, sharding
from .storage import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs, train(docs.where("not held_out")), keep=("doc_id", "held_out"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .linededup import dedup_report

    report = dedup_report(table(spark, sf_dir, "documents"))
    return report.withColumn("kept_lines", F.array_join(F.transform("kept_lines", lambda x: x.cast("string")), ","))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import decode_column, encode_column

    return decode_column(encode_column(table(spark, sf_dir, "documents")))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken

    return taken(mix(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digests, scan

    return digests(scan(table(spark, sf_dir, "documents")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reputation import judge, page_outcomes

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).drop("bad_rate")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_table(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_blocks import token_table

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_png_media": op4_png_media,
    "op5_token_blocks": op5_token_blocks,
    "op6_mix_sources": op6_mix_sources,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_reputation": op9_url_reputation,
    "op10_chat_format": op10_chat_format,
    "op11_phrases": op11_phrases,
    "op12_jump_shards": op12_jump_shards,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": jaccard.oracle_sql(),
    "op9_url_reputation": reputation.oracle_sql(),
    "op10_chat_format": chat.oracle_sql(),
    "op11_phrases": phrases.oracle_sql(),
    "op12_jump_shards": sharding.oracle_sql(),
    "op13_merkle": merkle.oracle_sql(),
}
