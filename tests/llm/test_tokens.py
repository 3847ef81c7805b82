import zlib

import numpy as np
import public_tokenizers
import pytest

from pulsegrid.llm import token_blocks as T
from pulsegrid.llm.storage import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 50_000, 1 << 32])
def test_blocks(n, top):
    rng = np.random.default_rng(n + 1)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.05] = min(top - 1, 2**32 - 1)
    off, raw = T.pack_blocks(ids)
    raw = np.frombuffer(raw, np.uint8)
    assert np.array_equal(T.unpack_blocks(raw, off, n), ids)
    if n > 1200:
        assert np.array_equal(T.unpack_blocks(raw, off, n, 1, 2), ids[512:1024])  # one block by the index


def texts(spark, sf):
    made = ["", "a", " a", "a  b", "a\n\nb", "\n", "don't we're 'tis", "x y 　z", "É,é.. «a»", "<|endoftext|> a<|endoftext|>", "\t a\r\n b ", "中文 字,字", "a 1.5 2,000's", "é'll \x7f\x00 b", "word" * 50_000, "…, — b\u0085c"]
    return made + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]


def test_words_give_the_tokenizers_ids(spark, sf):
    enc = T.WordEncoder(PATH)
    some = texts(spark, sf)
    for size in (1 << 18, 64):  # also with a cache that is trimmed all the time
        T.CACHE_WORDS, old = size, T.CACHE_WORDS
        raw = [t.encode() for t in some]
        off = np.cumsum([0, *map(len, raw)])
        ids, counts = enc.encode(np.frombuffer(b"".join(raw), np.uint8), off)
        T.CACHE_WORDS = old
        at = 0
        for t, n, e in zip(some, counts.tolist(), enc.tokenizer.encode_batch(some, add_special_tokens=False)):
            assert ids[at : at + n].tolist() == e.ids, t[:50]
            at += n


def test_table(spark, sf):
    rows = [(i * 3 % 41, t) for i, t in enumerate(["b c", None, "", "d\ne", "f"])] + [(7, "same"), (7, "same"), (None, "first")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, start int").repartition(3)
    path = new_path(spark, "test-tokens")
    T.write_segments(df, path, PATH, 2)
    out = T.read_segments(spark, path).orderBy("start").collect()
    enc = T.encoder(PATH).tokenizer
    start = 0
    for r, (d, t) in zip(out, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (d, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(out) == len(rows)
    assert T.token_table(df.limit(0), PATH).count() == 0


def test_many_segments(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(tuple(r) for r in T.token_table(docs, PATH).collect())
    monkeypatch.setattr(T, "SEGMENT_IDS", 5000)
    assert sorted(tuple(r) for r in T.token_table(docs.repartition(5), PATH).collect()) == want


def plain(texts):
    from tokenizers import Tokenizer

    return [Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids for t in texts]


def encoded(enc, texts):
    raw = [t.encode() for t in texts]
    ids, counts = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist())]


def test_special_token_as_the_library_does():
    some = ["<|endoftext|> a", "a  <|endoftext|>  b   ", "<|endoftext|", "|><|endoftext|>", "x   ", "y", "<|end", "oftext|>"]
    assert encoded(T.WordEncoder(PATH), some) == plain(some)
    assert plain(some)[0] == [50256, 257]


def test_words_with_equal_hashes_keep_their_ids(monkeypatch):
    """Whatever the hash, words are compared: with a hash that is always equal, ids are still right."""
    some = ["one two", "two one three", "a" * 100]
    enc = T.WordEncoder(PATH)
    monkeypatch.setattr(T.bk, "span_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    assert encoded(enc, some) == plain(some)


def test_thue_morse_words():
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    some = [word, word.translate(str.maketrans("ab", "ba"))]
    assert encoded(T.WordEncoder(PATH), some) == plain(some) and plain(some)[0] != plain(some)[1]
