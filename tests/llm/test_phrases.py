"""Collocations against counts of every n-gram, and their SQL."""

import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import phrases as P

SCHEMA = "doc_id long, lang string, text string"


def brute(rows, p):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, p.longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = {}
    common = {k: a for k, a in f.items() if a >= p.min_count and len(k[1]) > 1}
    for (lang, w), a in common.items():
        if any(x == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in common.items()):
            continue
        cuts = [(p.scale * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return sorted((lang, i + 1, w.decode(), -a, le, r, t, -s) for lang, found in out.items() for i, (s, a, w, le, r, t) in enumerate(sorted(found)[: p.top]))


def found(spark, rows, p):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in P.collocations(df, p).collect())


def some_rows(seed=3, n=150):
    r = random.Random(seed)
    words = ["a", "b", "Ä", "ä", "Foo", "foo", "x\x00y", "日本", "the", "of"] + [f"rare{i}" for i in range(200)]
    weights = [30, 20, 5, 5, 8, 9, 2, 3, 30, 20] + [0.1] * 200
    gap = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", ";", " "]
    rows = []
    for i in range(n):
        text = "".join(x for w in r.choices(words, weights, k=r.randrange(60)) for x in (w, r.choice(gap)))
        rows.append((r.choice(["en", "en", "de", None, "und", ""]), r.choice([text, text, text, None, "", "foo bar foo bar foo bar baz"])))
    return rows


@pytest.mark.parametrize("p", [P.PhraseParams(min_count=5, bits=15), P.PhraseParams(min_count=3, top=7), P.PhraseParams(longest=3, min_count=20), P.PhraseParams(longest=8, min_count=2, bits=15)])
def test_against_brute_force(spark, p):
    """Nulls, both kinds of ``und``, ties, line breaks, NUL, words of other scripts, and filters so small that most buckets pass."""
    rows = some_rows()
    want = brute(rows, p)
    assert want and found(spark, rows, p) == want


def test_shard_borders(spark, monkeypatch):
    """Shards overlap by less than a phrase: no n-gram is lost or counted twice, however short they are."""
    rng = np.random.default_rng(5)
    ids = rng.integers(-1, 4, 700)
    whole = {n: Counter() for n in range(2, 6)}
    for n in whole:
        for i in range(len(ids) - n + 1):
            if (ids[i : i + n] >= 0).all():
                whole[n][tuple(ids[i : i + n].tolist())] += 1
    for size in (1, 2, 3, 7, 64, 1000):
        got = {n: Counter() for n in whole}
        for a in range(0, len(ids), size):
            part = ids[a : a + size + 4]
            for n, at, f in P.grams(part, 5, size):
                for i, c in zip(at.tolist(), f.tolist()):
                    got[n][tuple(part[i : i + n].tolist())] += c
        assert got == whole


def test_suffix_array_order_and_lcp():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 2), (2, 1), (50, 2), (300, 5)):
        ids = rng.integers(0, kinds, n)
        order, lcp = P.suffix_array(ids, 5)
        heads = [tuple(ids[i : i + 5].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
        for a, b, k in zip(heads, heads[1:], lcp[1:].tolist()):
            same = next((i for i in range(5) if a[i : i + 1] != b[i : i + 1]), 5)
            assert k == min(same, len(a), len(b))


def test_gathered_counts_are_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "GATHERED_PHRASES", 10)
    rng, want, got, g = np.random.default_rng(2), Counter(), Counter(), P.Gathered()
    for _ in range(60):
        keys = [(f"l{rng.integers(2)}", int(rng.integers(3)), f"p{rng.integers(12)}", int(rng.integers(1, 9))) for _ in range(int(rng.integers(0, 9)))]
        for *k, f in keys:
            want[tuple(k)] += f
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*keys)) or [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "n", "phrase", "f"])
        for out in g.add(batch):
            for r in out.to_pylist():
                got[r["lang"], r["n"], r["phrase"]] += r["f"]
    for out in g.flush():
        for r in out.to_pylist():
            got[r["lang"], r["n"], r["phrase"]] += r["f"]
    assert got == want


def test_filters_only_save_work(spark):
    """A filter of few buckets lets rare words through, and the rows are the same."""
    rows = some_rows(9, 80)
    assert found(spark, rows, P.PhraseParams(min_count=4, bits=15)) == found(spark, rows, P.PhraseParams(min_count=4, bits=24))


def test_edges(spark):
    p = P.PhraseParams(min_count=2)
    assert found(spark, [], p) == [] and found(spark, [(None, None), ("en", ""), ("en", " \t.\n")], p) == []
    assert found(spark, [("en", "one two")] * 2, p) == brute([("en", "one two")] * 2, p)
    long = "w " * 60_000 + "verylong" * 20_000
    rows = [("en", long), ("en", "w w w")]
    assert found(spark, rows, p) == brute(rows, p)
    df = spark.createDataFrame([("a b", "a b", 1, "x")] * 3, "text string, lang string, rank int, phrase string")
    assert [r["phrase"] for r in P.collocations(df, p).collect()] == ["a b"]
    with pytest.raises(ValueError):
        P.PhraseParams(longest=1)


def test_large_numbers_are_exact(spark):
    """Products beyond 64 bits."""
    big = 3_000_000_000_000
    rows = [("en", 0, "", 7 * big), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)]
    df = spark.createDataFrame(rows, "lang string, n int, phrase string, f long")
    r = P.scored(df, P.PhraseParams()).first()
    assert r["score"] == 1000 * (big - 1) * 7 * big // (big * (big + 1))


def test_sql(spark, sf):
    p = P.PhraseParams(min_count=8)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.sql(P.oracle_sql(p)).fetchall()
    cols = [c[0] for c in con.sql(P.oracle_sql(p)).description]
    got = P.collocations(spark.read.parquet(f"{sf}/documents.parquet"), p)
    assert got.columns == cols and sorted(map(tuple, got.collect())) == sorted(want) and want


def test_rows_of_counts_are_bounded(spark, monkeypatch):
    """However many partitions the input has, a few tasks a core send each phrase; words of no frequent pair aren't sent."""
    p = P.PhraseParams(min_count=20)
    r = random.Random(8)
    rows = [("en", f"new york. alone. {r.choice('abcdefgh')} {r.choice('ijklmnop')} {i}") for i in range(600)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], SCHEMA).repartition(60)
    monkeypatch.setattr(P, "TASKS", 1, raising=False)
    real, sent = P.shard_counts, []
    monkeypatch.setattr(P, "shard_counts", lambda *a: sent.append(real(*a)) or sent[-1])
    assert sorted(tuple(x) for x in P.collocations(df, p).collect()) == brute(rows, p)
    counts = Counter(x["phrase"] for x in sent[0].collect())
    assert 0 < counts["new york"] <= spark.sparkContext.defaultParallelism and counts["york"] and not counts["alone"]


def test_bucket_counts_take_bounded_memory(monkeypatch):
    """What a task gathers is added up in a few bytes an entry, and goes on in batches of bounded size; sums are exact."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 1 << 21, dtype=np.uint64) << np.uint64(1)
    hashes[::3] = hashes[0]
    monkeypatch.setattr(P, "GATHERED", 1 << 21)
    monkeypatch.setattr(P, "sequences", lambda batch: iter([hashes[i : i + (1 << 18)] for i in range(0, len(hashes), 1 << 18)]))

    class Docs:
        def mapInArrow(self, fn, schema):
            self.fn = fn
            raise InterruptedError

    docs = Docs()
    with pytest.raises(InterruptedError):
        P._bucket_counts(docs, lambda s: [(s, None), (s[:1000], np.full(1000, 5))], P.PhraseParams(bits=20), 2)
    tracemalloc.start()
    got, most = np.zeros(2 << 20, np.int64), 0
    for batch in docs.fn([None]):
        np.add.at(got, batch.column(0).to_numpy(), batch.column(1).to_numpy())
        most = max(most, batch.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=1 << 20)
    assert (got[: 1 << 20] == want).all() and got[1 << 20 :].sum() == 8 * 5000
    assert most <= 1 << 16 and peak - got.nbytes < 40 * len(hashes)
