import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import secrets as S


def brute(text):
    found = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    return [(S.KINDS[k], a, b) for a, k, b in sorted(found)]


CASES = [
    "", "password=abcdef", "PassWord : 'abc123' x", "secret=token: abcdef", "token=abc secret=abcdefg", "api_key='AKIA" + "A1" * 10 + "'", "apikey:" + "a0" * 20, "ſecret=abcdefgh", "é token=\"0123456789abcdef01234567\"",
    "AKIA" + "Z" * 15, "AKIAAKIA" + "Z" * 12, "f" * 23 + " " + "f" * 24 + "F", "password password= =abcdefg", "password\n=abcdefg", "x" * 100_000 + " token=abcdef",
]


@pytest.mark.parametrize("text", CASES)
def test_base(text):
    assert S.base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def net():
    return S.train()


def test_held_out_findings(net):
    found = S.labelled_findings(600, 12345)
    x = [S.encode(t, a, b) for t, a, b, _ in found]
    y = np.array([v for *_, v in found])
    said = net.score(x) >= net.threshold
    assert said[y == 1].mean() >= 0.9 and said[y == 0].mean() <= 0.05


def test_recall_on_findings_of_documents(spark):
    """Findings of documents that the network didn't see: it would add nearly all if the patterns weren't there."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = S.train(findings=S.corpus_findings(docs.where(~held)))
    scores, others = [], []
    for r in docs.where(held).where(F.col("text").rlike("(?i)token|secret|passw|api_?key|akia|[0-9a-f]{24}")).collect():
        base = S.base_spans(r["text"])
        scores += net.score([S.encode(r["text"], *S.value_span(r["text"], s)) for s in base]).tolist() if base else []
        spans = S.other_candidates(r["text"], base)
        others += net.score([S.encode(r["text"], *s) for s in spans]).tolist() if spans else []
    assert len(scores) >= 50 and np.mean(np.array(scores) >= net.threshold) >= 0.9


def test_scores_do_not_depend_on_neighbours(net):
    """A candidate's score is the same alone, among longer ones, and cut in pieces."""
    rng = np.random.default_rng(5)
    text = "".join("abcdef0123456789"[i] for i in rng.integers(0, 16, 20_000))
    found = [S.encode(f"a token = '{text}' here", 11, 11 + n) for n in (9, 40, 3000, 4096)]
    together = net.score(found)
    assert np.allclose(together, [net.score([e])[0] for e in found], atol=1e-6)
    assert np.allclose([net._pooled_long(e) for e in found], [net._pooled([e], 1 << 13)[0] for e in found], atol=1e-4)
    assert 0 <= net.score([S.encode(text, 0, 20_000)])[0] <= 1


def test_many_findings_in_one_text():
    text = " ".join(f"token=abcdef{i} Zx81kQpL{i}" for i in range(30_000))
    base = S.base_spans(text)
    assert len(base) == 30_000 and len(S.other_candidates(text, base)) == 30_000


def test_same_training_same_net(net):
    other = S.train(S.NetParams(examples=200, epochs=1))
    again = S.train(S.NetParams(examples=200, epochs=1))
    assert np.array_equal(other.conv, again.conv) and other.threshold == again.threshold


def test_scan(spark, net):
    key = "sk-Zx81kQpL0vTn5RwYc3Bd7HjM9"
    rows = [(i, t) for i, t in enumerate([None, *CASES, f"use {key} now", "thanderinganther and enoueror-2041-theran"])] + [(2, "password=abcdef")]
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, starts array<int>")
    out = S.digests(S.scan(df, net)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, t in rows:
        want = brute(t or "")
        r = by[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for n, _, _ in want) for k in S.KINDS[:3]]
        assert r["base_sha256"] == hashlib.sha256(S.joined(want).encode()).hexdigest()
        assert {S.joined([w]) for w in want} <= set(r["spans"].split(","))
    added = by[len(CASES) + 1]
    assert added["spans"] == f"cnn:4:{4 + len(key)}" and added["n_cnn"] == 1
    assert by[len(CASES) + 2]["spans"] == ""
    assert S.scan(df.limit(0), net).count() == 0


def test_candidates_leave_base_alone():
    text = "token=abcdef0123456789abcdef and Zx81kQpL0vTn5RwYc3Bd"
    base = S.base_spans(text)
    assert [text[a:b] for a, b in S.other_candidates(text, base)] == ["Zx81kQpL0vTn5RwYc3Bd"]
