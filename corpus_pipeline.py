"""Corpus pipeline: language, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs; all but the last return the columns of ``documents``. The stages
read their own tables from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.storage import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; ``und`` and ambiguous ones go. Labels stay as they are."""
    from pulsegrid.llm.language import held_out, identify, train

    docs = docs.select(*COLUMNS)
    model = train(docs.where(~held_out()))
    found = identify(docs, model, keep=COLUMNS)
    return found.where("lang_pred != 'und' and not ambiguous").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the n-gram Jaccard join stays: the one of smallest doc_id."""
    from pulsegrid.llm.jaccard import one_of_each_group

    return one_of_each_group(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    from pulsegrid.llm.decontaminate import without_matches

    return without_matches(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard and shuffled within a shard."""
    from pulsegrid.llm.mixing import mixed_documents

    return mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in block files, and what reading them gives: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    from pulsegrid.llm.token_blocks import token_table

    return token_table(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("jaccard_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("token_blocks", tokens),
]

#: Language models, tokenizers and hashes of this engine are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
