"""The Merkle manifest against trees built in Python, and its SQL."""

import hashlib
import random
import zlib
from itertools import groupby

import duckdb
import pytest

from pulsegrid.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, pos long, group string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    values = (r[0], r[3], r[2], r[4], text)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, fan):
    """Root and, for each leaf, its siblings before and behind on every level."""
    paths, nodes, owners = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for a in range(0, len(nodes), fan):
            run = nodes[a : a + fan]
            for k in range(len(run)):
                for leaf_no in owners[a + k]:
                    paths[leaf_no].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H("".join(run)))
            up_owners.append(sum(owners[a : a + fan], []))
        nodes, owners = up, up_owners
    return nodes[0], paths


def brute(rows, fan):
    key = lambda r: (r[3] is not None, (r[3] or "").encode())
    groups = []
    for _, g in groupby(sorted(rows, key=key), key):
        g = sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        groups.append((g, *tree([leaf(r, r[1]) for r in g], fan)))
    root, tops = tree([sub for _, sub, _ in groups], fan)
    out = []
    for (g, sub, paths), top in zip(groups, tops):
        for r, path in zip(g, paths):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            acc = leaf(r, text)
            for before, behind in path + top:
                acc = H(before + acc + behind)
            out.append((r[0], leaf(r, r[1]), sub, root, H("".join(b + a for b, a in path + top)), acc, acc == root))
    return sorted(out, key=str)


def found(spark, rows, fan):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in M.merkle_report(df, M.MerkleParams(fan)).collect()), key=str)


def some_rows(n, seed=2):
    r = random.Random(seed)
    return [(r.choice([i, i, i, None, 4]), r.choice(["Text", "é Ü", None, "", "x" * 3000, "tExt 1:2"]), r.choice(["en", None, ""]), r.choice(["a", "a", "a", "b", "ä", None, "", f"own{i}"]), r.choice([5, None, -7]), i, "g") for i in range(n)]


@pytest.mark.parametrize("n, fan", [(400, 16), (150, 2), (90, 3), (17, 16), (1, 16), (2, 2)])
def test_against_brute_force(spark, n, fan):
    """Null and repeated ids, null and clashing columns, sources of one row, an empty and a null source, several heights."""
    rows = some_rows(n)
    rows += rows[:5] if n > 5 else []
    assert found(spark, rows, fan) == brute(rows, fan)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = M.merkle_report(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_tampering_shows(spark, sf):
    out = M.merkle_report(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    harmed = out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert out[~harmed].verified.all() and not out[harmed].verified.all() and (out.verified == (out.folded_root == out.root)).all()


def test_levels_are_bounded(spark):
    """A node has at most ``fanout`` children, and every level is a table of its own."""
    df = spark.range(1000).selectExpr("'g' as group", "id", "sha2(string(id), 256) as digest")
    tree = M.build(df, ("id",), M.MerkleParams(10), ("id",))
    assert [x.count() for x in tree.levels] == [100, 10, 1] and len(tree.top) == 1
    assert max(r[0] for x in tree.levels for r in x.selectExpr("size(children)").collect()) == 10
    with pytest.raises(ValueError):
        M.MerkleParams(1)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    rel = con.sql(M.oracle_sql())
    got = M.merkle_report(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
