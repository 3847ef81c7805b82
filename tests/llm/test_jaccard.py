import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import bytekernel as bk
from pulsegrid.llm import jaccard as J

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, width=4, percent=85):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for e in holders[x]:
                if e < d:
                    both[e] += 1
        for e, k in both.items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {(d, len(sets[d]), root(d)) for d in sets}


def joined(df, **kw):
    return {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, **kw).collect()}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert joined(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_made_groups(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 9, 30, 80, 200]))]
        for _ in range(rng.randint(1, 9)):
            v = list(words)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert joined(df) == want
    monkeypatch.setattr(J, "MAX_GROUP", 3)  # components searched as pairs of blocks
    assert joined(df) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one two three"), (7, "é É"), (None, "one two"), (8, "a " * 50_000), (8, "a b c d e")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, set_id int, comp string")
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (None, 1, 4), (8, 1, 8), (8, 2, 8)]
    assert out == sorted(want, key=str)
    assert J.jaccard_components(df.limit(0)).count() == 0
    assert J.jaccard_components(df.where("doc_id < 3")).count() == 2


@pytest.mark.parametrize("percent", [50, 70, 85])
def test_kernels(percent):
    rng = random.Random(percent)
    for _ in range(60):
        base = [rng.sample(range(200), rng.randint(1, 60)) for _ in range(4)]
        sets = []
        for _ in range(rng.randint(1, 25)):
            b = list(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                b[rng.randrange(len(b))] = rng.randrange(300)
            sets.append(np.unique(np.array(b, np.uint64)))
        segments = J.Segments(percent)
        sizes, flat, n = np.array([len(s) for s in sets]), np.concatenate(sets), len(sets)
        nodes = segments.nodes(np.arange(n).astype(np.uint64), sizes)
        marks = np.isin(flat, np.array(rng.sample(range(300), rng.choice([0, 30, 280])), np.uint64))
        sig, node = segments.signatures(flat, sizes, nodes, marks)
        owner = {int(v): i for a in nodes for i, v in enumerate(a.tolist())}
        by = defaultdict(set)
        for s, o in zip(sig.tolist(), node.tolist()):
            by[owner[o]].add(s)
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(n):
            for j in range(i):
                if J.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])), percent):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
                    assert by[i] & by[j]
        assert J.link_groups(sets, percent) == [root(i) for i in range(n)]


def test_span_hashes_follow_content():
    data = np.frombuffer("ab cd abé cd".encode(), np.uint8)
    s, e, c = bk.words(data, np.array([0, 6, len(data)]))
    h = bk.span_hashes(data, s, e)
    assert c.tolist() == [2, 2] and h[1] == h[3] and h[0] != h[2]


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_of_one_arithmetic_sum_differ(spark):
    """The Thue-Morse word and its complement defeat every polynomial hash modulo 2 ** 64."""
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (8, 64, 65, 1024, 2048):
        data = np.frombuffer((word[:n] + " " + other[:n]).encode(), np.uint8)
        h = bk.span_hashes(data, *bk.words(data, np.array([0, len(data)]))[:2])
        assert h[0] != h[1]
    rows = [(1, word), (2, other), (3, word)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def test_span_hashes_at_every_length():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, 200).astype(np.uint8)
    seen = {}
    for n in range(1, 140):
        for at in (None, 0, n // 2, n - 1):
            span = base[:n].copy()
            if at is not None:
                span[at] ^= 1
            data = np.concatenate((np.frombuffer(b"zz", np.uint8), span, np.frombuffer(b"q", np.uint8)))
            h = int(bk.span_hashes(data, np.array([2]), np.array([2 + n]))[0])
            assert seen.setdefault(h, span.tobytes()) == span.tobytes()


def test_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30 ", "x30 ")
    rows = [(5, text), (3, near), (3, near), (7, "quite another text of its own"), (7, text + " more"), (None, text), (None, "nobody else has this one"), (None, "nobody else has this one"), (8, None), (9, "")]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, set_id string, comp int")
    out = J.one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(3, near), (7, rows[3][1]), (None, rows[6][1]), (8, None), (9, "")], key=str)


def test_hot_component_is_spread(spark):
    df = spark.createDataFrame([(i % 3 and 1, i, 10) for i in range(300)], "comp long, set_id long, n_shingles long")
    out = J.spread_join(df, "comp", "set_id", F.sum, F.lit(1), "k").groupBy("comp", "k").count().collect()
    assert sorted(tuple(r) for r in out) == [(0, 100, 100), (1, 200, 200)]


def test_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("a", "B", "c\td", "é")) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(100, None), (101, "A b"), (102, "a B")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert {(r[0], r[1], r[2]) for r in con.sql(J.oracle_sql()).fetchall()} == brute(rows) == joined(spark.createDataFrame(rows, "doc_id long, text string"))


def test_links_through_rows_without_an_id(spark):
    """A chain whose middle has no id links its ends; rows without ids link with each other and have no smallest id."""
    words = [f"w{i}" for i in range(80)]
    text = lambda a, b: " ".join(words[a:b])
    rows = [(1, text(0, 60)), (None, text(4, 64)), (2, text(8, 68)), (None, "x " + text(70, 80)), (None, "x " + text(70, 80) + " y"), (None, "x " + text(70, 80)), (None, "unlike all others here")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()), key=str)
        assert out == sorted([(1, 57, 1), (None, 57, 1), (2, 57, 1), (None, 8, None), (None, 9, None), (None, 8, None), (None, 1, None)], key=str)
        kept = [r["text"] for r in J.one_of_each_group(df).collect()]
        assert len(kept) == 3 and text(0, 60) in kept and rows[6][1] in kept


def test_sql_links_through_rows_without_an_id(spark):
    import duckdb

    words = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(words[:60])), (None, " ".join(words[4:64])), (2, " ".join(words[8:68])), (2, "another text of that id"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in J.jaccard_components(df).collect())
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in rows])
    want = sorted((str(a), n, str(c)) for a, n, c in con.sql(J.oracle_sql()).fetchall())
    assert got == want
