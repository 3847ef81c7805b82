import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import decontaminate as D


def norm(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (text or "").lower()).encode()


def distance(pattern, text):
    """Least edits of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_normal_form():
    texts = ["A  b--C", " x", "É!É", "", "...", "a\n\tb "]
    data, off = D.normalised(pa.array(texts))
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(off[:-1], off[1:])] == [norm(t) for t in texts]


def test_myers():
    rng = random.Random(1)
    for _ in range(300):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 70)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        want = distance(p, t)
        got = D.edit_distance(p, t, len(p))
        assert (got[0] if got else len(p)) == min(want, len(p))
        assert (D.edit_distance(p, t, want - 1) is None) if want else True


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        i = rng.randrange(max(1, len(out)))
        out[i : i + rng.choice([0, 1])] = rng.choice(["", "q", "zz"])
    return "".join(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 25)))) for i in range(12)] + [(90, None), (91, ""), (92, "tiny"), (93, "..")]
    docs = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:12])[1]
            parts.append(edited(rng, item, rng.randint(0, max(1, len(item) // 6))).upper())
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "so Tiny!"), (103, " ".join(["pad"] * 60_000) + " " + items[0][1]), (104, items[1][1]), (104, items[1][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in D.matches(d, b).collect())
    want = []
    for i, t in docs:
        for j, s in items:
            p, x = norm(s).strip(), norm(t)
            if not p:
                continue
            k = min(int(0.1 * len(p) + 1e-9), len(p) - 1)
            if len(x) > 10_000:
                e = 0 if p in x else k + 1
            else:
                e = distance(p, x)
            if e <= k:
                want.append((i, j, e))
    assert got == sorted(want)
    dirty = {i for i, _, _ in want}
    kept = D.without_matches(d, b)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i not in dirty) and kept.columns == d.columns
    assert D.matches(d.limit(0), b).count() == 0 and D.matches(d, b.limit(0)).count() == 0 and D.without_matches(d, b.limit(0)).count() == len(docs)


def test_item_blocks(spark, monkeypatch):
    b = spark.createDataFrame([(i, f"item number {i} with some text of its own") for i in range(40)], "item_id long, text string")
    blocks = list(D.item_blocks(b, block_bytes=300))
    assert len(blocks) > 2 and sorted(i for x in blocks for i, _, _ in x) == list(range(40))


def test_several_blocks_give_the_rows_of_one(spark, monkeypatch):
    """Block by block: same matches, same rows left, and the caller's own table stays."""
    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(8))) for i in range(12)]
    docs = [(i, "before " + edited(rng, items[i % 12][1], 3) + " after" if i % 3 else "nothing of the kind in here") for i in range(40)]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    own = D.written(d, "own-documents")
    want, left = sorted(map(tuple, D.matches(d, b).collect())), sorted(map(tuple, D.without_matches(own, b).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 4_000)
    assert D.block_count(b) > 2 and len(want) > 20
    assert sorted(map(tuple, D.matches(d, b).collect())) == want
    assert sorted(map(tuple, D.without_matches(own, b).collect())) == left
    assert own.count() == 40


def test_windows():
    data = np.frombuffer(b"abcdefghij", np.uint8)
    assert int(D.windows(data)[1]).to_bytes(8, "little") == b"bcdefghi"


def test_short_items_keep_their_budget(spark):
    """Items of 10 to 40 bytes with as many edits as 10 % allow, and one more."""
    rng = random.Random(8)
    items, docs, want = [], [], []
    for i, m in enumerate((10, 15, 20, 23, 30, 31, 35, 40)):
        text = "".join(rng.choice("abcdefghij") for _ in range(m))
        items.append((i, text))
        for extra in (0, 1):
            out = list(text)
            for at in rng.sample(range(m), int(0.1 * m) + extra):
                out[at] = "z"
            docs.append((len(docs), "qq " + "".join(out) + " vv"))
            e = distance(text.encode(), docs[-1][1].encode())
            if e <= int(0.1 * m):
                want.append((docs[-1][0], i, e))
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == sorted(want) and len(want) >= 8


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.3])
def test_error_rates(rate):
    rng = random.Random(int(rate * 10))
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    items = [(i, word(rng.randint(1, 30)).encode(), 1) for i in range(25)]
    texts = ["".join(word(5) + edited(rng, rng.choice(items)[1].decode(), rng.randint(0, 4)) for _ in range(3)).encode() for _ in range(25)]
    index = D.PieceIndex(items, D.MatchParams(rate))
    off = np.cumsum([0, *map(len, texts)])
    got = {(r, i): d for r, i, d, *_ in index.search(np.frombuffer(b"".join(texts), np.uint8), off)}
    want = {(r, i): distance(p, t) for r, t in enumerate(texts) for i, (_, p, _) in enumerate(items) if distance(p, t) <= min(int(rate * len(p) + 1e-9), len(p) - 1)}
    assert got == want


def test_repeated_items_and_null_ids(spark):
    text = "this is the benchmark item that repeats itself"
    b = spark.createDataFrame([(5, text), (5, text), (None, text), (6, text)], "item_id long, text string")
    d = spark.createDataFrame([(1, "x " + text), (None, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in D.matches(d, b).collect()), key=str)
    assert got == sorted([(x, y) for x in (1, None) for y in (5, 5, 6, None)], key=str)
    assert D.without_matches(d, b.where("item_id is null")).count() == 0
