import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing as M


def targets(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if out[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return out
        capped |= over


def check(rows, out):
    sizes, taken = Counter(), Counter()
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    top = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert len(r["draws"]) <= 3
        taken[r["source"]] += r["size"] * len(r["draws"])
        top[r["source"]] = max(top[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= top[s]
    return sizes, want, taken


def test_small_sources(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{i % 7}" if i % 11 else None) for i in range(600)]
    rows += [(1000, "a b c", "tiny"), (1001, None, "void"), (1002, "", "void")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, source string, size int, u string")
    out = M.mix(df, M.MixParams(block_docs=16, shard_words=300)).collect()
    assert len(out) == len(rows)
    check(rows, out)
    again = M.mix(df.repartition(7), M.MixParams(block_docs=16, shard_words=300)).collect()
    key = lambda r: (r["doc_id"], [tuple(d) for d in r["draws"]])
    assert sorted(map(key, out)) == sorted(map(key, again))
    shards = {d["shard"] for r in out for d in r["draws"]}
    n = 2 ** math.ceil(math.log2(sum(len((t or "").split()) for _, t, _ in rows) / 300))
    assert shards <= set(range(n)) and len(shards) > n // 2


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    out = M.mix(docs).collect()
    check(rows, out)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == ["_shard", "_place", *docs.columns]
    assert mixed.count() == sum(len(r["draws"]) for r in out)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["target"], len(r["draws"])) for r in M.mix(df).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert M.mix(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b", "s")] * 4 + [(2, "c", "t")], "doc_id long, text string, source string")
    assert M.mix(twice).count() == 5


def test_hypergeometric(spark):
    u = "(shiftrightunsigned(xxhash64(id), 11) / 9007199254740992d)"
    for big, k, n in ((100, 30, 40), (10, 10, 3), (7, 0, 5), (0, 0, 0), (5, 3, 5), (1000, 500, 1)):
        d = np.array([r[0] for r in spark.range(3000).select(F.expr(M.hypergeometric(f"{big}L", f"{k}L", f"{n}L", u))).collect()])
        assert d.min() >= max(0, n + k - big) and d.max() <= min(n, k)
        if big > 1:
            var = n * k / big * (1 - k / big) * (big - n) / (big - 1)
            assert abs(d.mean() - n * k / big) <= 5 * math.sqrt(var / 3000) + 1e-9
            assert abs(d.var() - var) <= 0.15 * var + 1e-9


def test_tree_keeps_quotas(spark):
    quotas = {0: 10, 1: 100, 2: 1, 3: 0}
    q = spark.createDataFrame(list(quotas.items()), "source_no int, blocks long")
    rows = M.splitting_tree(q, 3, 5).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r["source_no"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
        assert r["blocks"] >= 0
    assert dict(by_source) == {k: v for k, v in quotas.items()} and len(by_shard) == 8
    assert max(by_shard.values()) - min(by_shard.values()) <= 2


def test_repeated_and_null_ids(spark):
    """Rows are mixed one by one: equal ones each as often as the other, rows without an id like any."""
    rows = [(1, "a b c d", "s")] * 2 + [(1, "other text of this id", "s"), (None, "no id here", "s"), (None, "no id here", "t"), (2, "e f", "t"), (None, None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, place int")
    want = {}
    for r in M.mix(df).collect():
        want.setdefault((r["doc_id"], r["size"], r["source"]), []).append(len(r["draws"]))
    assert all(len(set(v)) == 1 for v in want.values())
    out = Counter((r["doc_id"], len((r["text"] or "").split()), r["source"]) for r in M.mixed_documents(df).collect())
    assert out == Counter({k: sum(v) for k, v in want.items() if sum(v)}) and max(out.values()) <= 6
    assert any(k[0] is None for k in out)


def test_plan_has_no_shard_arrays(spark, sf):
    """Rows carry the few places of their block, whatever the number of shards; blocks are the least that a shard holds."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = M.plan_mix(docs, M.MixParams(block_docs=1, shard_words=100), "doc_id", "text", "source")
    assert plan.placement.select(F.max(F.size("at"))).first()[0] <= M.MAX_EPOCHS + 1
    shards = plan.placement.select(F.explode("at.shard").alias("s")).distinct().count()
    assert shards > 100 and not {"ends", "shards"} & set(M.with_draws(plan.sized, plan, 17).columns)
