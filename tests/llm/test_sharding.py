"""Jump consistent hashing against the written algorithm, shards as files, and their SQL."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import sharding as S

SCHEMA = "doc_id long, text string, shard int, at string"


def jump_one(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_known_hash():
    rng = np.random.default_rng(3)
    keys = np.concatenate((np.arange(50, dtype=np.uint64), rng.integers(0, 2**64, 200, dtype=np.uint64)))
    for n in (1, 2, 3, 8, 9, 100, 5000):
        assert S.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]


def test_growth_moves_only_into_new_shards():
    keys = S.spread(np.arange(200_000))
    before = S.jump(keys, 8)
    for n in (9, 12):
        after = S.jump(keys, n)
        gone = before != after
        assert (after[gone] >= 8).all() and abs(gone.mean() - (1 - 8 / n)) < 0.01
        assert np.abs(np.bincount(after) * n / len(keys) - 1).max() < 0.03
    for step in (2, 1 << 20, 1 << 40):  # ids with a common factor are as even
        assert np.abs(np.bincount(S.jump(S.spread(np.arange(100_000) * step), 8)) * 8 / 1e5 - 1).max() < 0.05


def report(spark, rows, params=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return [r.asDict() for r in S.shard_report(df, params).collect()]


def test_report(spark):
    """Null ids and texts, repeated rows, columns named as the layout's own."""
    rows = [(i, f"text {i} é", i, "x") for i in range(300)] + [(None, "no id", 1, "y")] * 40 + [(7, None, 0, None), (7, "", 0, None), (-5, "minus", 3, "z")]
    out = report(spark, rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0))
        key = np.array([r["doc_id"] or 0], np.int64).view(np.uint64)
        assert r["shard"] == jump_one(int(S.spread(key)[0]), 8) and r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    for found in slots.values():
        found.sort()
        assert [s[0] for s in found] == list(range(len(found))) and [s[1:] for s in found] == sorted(s[1:] for s in found)
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1


def test_empty_and_one_shard(spark):
    assert report(spark, []) == []
    out = report(spark, [(i, "t", None, None) for i in range(20)], S.ShardParams(1))
    assert sorted(r["slot"] for r in out) == list(range(20)) and {r["shard"] for r in out} == {0}
    with pytest.raises(ValueError):
        S.ShardParams(0)


def test_files(spark, tmp_path):
    """Whole rows come back, one shard can be read alone, and a shard is more than one file where it has the rows."""
    df = spark.range(4000).selectExpr("id as doc_id", "concat('t', id) as text", "id % 3 as shard", "array(id) as row").repartition(5)
    path = str(tmp_path / "shards")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        S.write_shards(df, path, S.ShardParams(2))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = S.read_shards(spark, path, df.schema)
    assert sorted(back.select("row.*").collect()) == sorted(df.collect())
    one = S.read_shards(spark, path, df.schema, shards=[1])
    assert one.count() == back.where("shard = 1").count() > 0
    assert spark.read.parquet(f"{path}/index").groupBy("shard").count().agg({"count": "max"}).first()[0] > 1


def test_moved(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "'x' as row")
    out = S.moved(df, 8, 10).collect()
    assert {r["to_shard"] for r in out} == {8, 9} and 0.15 < len(out) / 5000 < 0.25
    named = spark.createDataFrame([(f"id-{i}", "x") for i in range(500)], "doc_id string, text string")
    assert set(S.moved(named, 8, 9).select("to_shard").distinct().toPandas()["to_shard"]) == {8}


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    rel = con.sql(S.oracle_sql())
    got = S.shard_report(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
