"""Shards by jump consistent hashing: a stable key and the number of shards decide, no table of a ring is kept.

With one shard more, a key stays where it is or moves to the new shard, which takes 1 / (shards + 1) of the keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import in_order, numbered, starts
from .storage import new_path

_U = np.uint64
#: Step of the 64-bit linear congruential generator of the jump hash, and the key of rows without an id.
LCG, NO_KEY = 2862933555777941757, 0
#: Shifts and factors of the 64-bit finaliser that spreads keys before they jump.
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
LAW = "key"


@dataclass(frozen=True)
class ShardParams:
    shards: int = 8

    def __post_init__(self):
        if not 1 <= self.shards < 1 << 31:
            raise ValueError("shards must be positive")


def spread(keys: np.ndarray) -> np.ndarray:
    """Keys as 64-bit numbers without the order or the common factors that ids have."""
    x = keys.astype(_U)
    for shift, factor in MIX:
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard (from 0) of each 64-bit key: the last of its jumps below ``shards``; about ln(shards) jumps a key."""
    state, at, to = keys.astype(_U), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = to[live]
        state[live] = state[live] * _U(LCG) + _U(1)
        draw = (state[live] >> _U(33)).astype(np.float64) + 1
        to[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[to[live] < shards]
    return at.astype(np.int32)


def key_of(docs: DataFrame, id_col: str) -> Column:
    """Integer ids are keys themselves, others by a hash of their text; rows without an id share one key."""
    integer = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    key = F.col(f"`{id_col}`").cast("long") if integer else F.xxhash64(F.col(f"`{id_col}`").cast("string"))
    return F.when(F.col(f"`{id_col}`").isNull(), F.lit(NO_KEY)).otherwise(key)


def shard_of(key: Column, *counts: int) -> Column:
    """Struct of s0, s1, ...: the shard of a key for each number of shards."""
    fields = T.StructType([T.StructField(f"s{i}", T.IntegerType(), False) for i in range(len(counts))])

    @F.pandas_udf(fields)
    def shards(keys: pd.Series) -> pd.DataFrame:
        x = spread(keys.to_numpy(np.int64).view(_U))
        return pd.DataFrame({f"s{i}": jump(x, n) for i, n in enumerate(counts)})

    return shards(key)


def moved(docs: DataFrame, before: int, after: int, id_col: str = "doc_id") -> DataFrame:
    """Rows whose shard changes when there are ``after`` shards instead of ``before``: all columns as ``row``, from_shard, to_shard."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    s = docs.select(row, shard_of(key_of(docs, id_col), before, after).alias("s"))
    return s.where("s.s0 != s.s1").select("row", F.col("s.s0").alias("from_shard"), F.col("s.s1").alias("to_shard"))


def write_shards(docs: DataFrame, path: str, params: ShardParams | None = None, id_col: str = "doc_id") -> None:
    """Write ``docs`` to ``path``/rows, one folder a shard, ordered by id within it, and an index of the files' parts to ``path``/index.

    A shard is as many tasks and files as its rows need: rows are dealt by ranges of shard and id, those without an id first, and equal
    ids by their place in the input. A row is kept whole in the column ``row``, so its columns may have any names. An empty
    table gives an empty set of shards.
    """
    params = params or ShardParams()
    n = params.shards
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = docs.select(row, key_of(docs, id_col).alias("key"), F.col(f"`{id_col}`").alias("id")).withColumn("s", shard_of(F.col("key"), n, n + 1))
    flat = placed.select(F.col("s.s0").alias("shard"), F.col("s.s1").alias("grown"), "id", "row")
    in_order(flat, "shard", "id").select("at", "grown", "row", "shard").write.partitionBy("shard").parquet(f"{path}/rows")
    rows = _rows(docs.sparkSession, path, docs.schema)
    starts(rows.select("shard", "at"), "shard").write.parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType([T.StructField("at", T.LongType()), T.StructField("grown", T.IntegerType()), T.StructField("row", schema), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(whole).parquet(f"{path}/rows")


def read_shards(spark: SparkSession, path: str, schema: T.StructType, columns: dict[str, Column] | None = None, shards: list[int] | None = None) -> DataFrame:
    """shard, slot (from 0 in each shard, without gaps, in order of ids), grown (shard if there were one more) and ``columns``, made of
    ``row`` while it is read (default: ``row`` itself); only the folders of ``shards`` are read where they are given."""
    rows = _rows(spark, path, schema)
    if shards is not None:
        rows = rows.where(F.col("shard").isin(shards))
    made = columns or {"row": F.col("row")}
    return numbered(rows.select("shard", "grown", "at", *[c.alias(name) for name, c in made.items()]), spark.read.parquet(f"{path}/index"), "shard", "slot")


def shard_report(docs: DataFrame, params: ShardParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and read them back: doc_id, size (UTF-8 bytes of the text and 1), text_crc32,
    law, shard, slot, grown_shard of every row.

    Rows of one id lie in one shard, whatever their texts are, as do all without an id; equal texts of different ids are
    placed on their own. Null texts have no bytes. Repeated rows have slots of their own.
    """
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    write_shards(narrow, path, params)
    text = F.coalesce("row.text", F.lit(""))
    digests = {"doc_id": F.col("row.doc_id"), "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    return read_shards(spark, path, narrow.schema, digests).select(*digests, F.lit(LAW).alias("law"), "shard", "slot", F.col("grown").alias("grown_shard"))


def oracle_sql(params: ShardParams | None = None) -> str:
    """DuckDB SQL for the rows of ``shard_report``; unsigned 64-bit arithmetic in 128 bits."""
    n = (params or ShardParams()).shards
    mixed = "k0"
    steps = []
    for i, (shift, factor) in enumerate(MIX):
        steps.append(f"m{i} as (select * exclude (k), cast((cast(xor(k, k >> {shift}) as uhugeint) * {factor}::uhugeint) % 18446744073709551616::uhugeint as ubigint) as k from {mixed})")
        mixed = f"m{i}"

    def jumps(name: str, shards: int) -> str:
        draw = f"cast((cast(k as uhugeint) * {LCG}::uhugeint + 1) % 18446744073709551616::uhugeint as ubigint)"
        return f"""
{name} as (select doc_id, k, cast(-1 as bigint) as b, cast(0 as bigint) as j from ids
  union all select doc_id, {draw}, j, cast(trunc((j + 1) * (2147483648.0::double / (cast({draw} >> 33 as double) + 1))) as bigint) from {name} where j < {shards}),
{name}_end as (select doc_id, max(b) as shard from {name} group by doc_id)"""

    return f"""
with recursive k0 as (select distinct doc_id, cast((coalesce(doc_id, {NO_KEY})::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint as ubigint) as k from documents),
{", ".join(steps)},
ids as (select * from {mixed}),{jumps("same", n)},{jumps("more", n + 1)},
bits as (select list(list_reduce(range(8), lambda c, x: xor(c >> 1, (c & 1) * 3988292384), v) order by v) as crc from range(256) as r(v)),
hexed as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id) as place from documents),
crcs as (select doc_id, place, octet_length(encode(text)) + 1 as size,
  xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast(('0x' || x) as bigint)), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)]), 4294967295)) as text_crc32
  from hexed, bits)
select c.doc_id, cast(c.size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, '{LAW}' as law, cast(a.shard as integer) as shard,
  row_number() over (partition by a.shard order by c.doc_id nulls first, place) - 1 as slot, cast(b.shard as integer) as grown_shard
from crcs c join same_end a on a.doc_id is not distinct from c.doc_id join more_end b on b.doc_id is not distinct from c.doc_id
"""
