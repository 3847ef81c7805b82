import hashlib
import struct
import zlib

import numpy as np
import pytest

from pulsegrid.llm import media as M


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (3, 4, 3), (40, 576)])
@pytest.mark.parametrize("kind", [(0, 1, 2), (0, 1, 2, 3, 4), 0, 1, 2, 3, 4])
def test_round_trip(shape, kind):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert np.array_equal(M.from_png(M.to_png(image, kind)), image)


@pytest.mark.parametrize("bpp", [1, 3])
def test_average_and_paeth_rows(bpp):
    image = np.random.default_rng(2).integers(0, 256, (6, 5 * bpp), dtype=np.uint8)
    rows = []
    for r, row in enumerate(image.astype(int)):
        above = image[r - 1].astype(int) if r else np.zeros(5 * bpp, int)
        kind, out = 3 + r % 2, []
        for i, v in enumerate(row):
            a, b, c = (row[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
            p = a + b - c
            guess = (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - guess) % 256)
        rows.append(bytes([kind, *out]))
    head = struct.pack(">IIBBBBB", 5, 6, 8, 0 if bpp == 1 else 2, 0, 0, 0)
    blob = M.SIGNATURE + M._chunk(b"IHDR", head) + M._chunk(b"IDAT", zlib.compress(b"".join(rows))) + M._chunk(b"IEND", b"")
    assert np.array_equal(M.from_png(blob).reshape(6, -1), image)


def test_stored_rows_are_filtered(spark, sf):
    """What the query writes needs unfiltering: rows of several filters occur."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    kinds = set()
    for r in M.encode_column(docs).collect():
        blob, at, data = bytes(r["media"]), 8, b""
        while at < len(blob):
            (n,) = struct.unpack_from(">I", blob, at)
            data += blob[at + 8 : at + 8 + n] if blob[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        kinds |= set(zlib.decompress(data)[:: M.ROW + 1])
    assert len(kinds) >= 2 and kinds <= {0, 1, 2}


def test_damage_is_found():
    blob = bytearray(M.to_png(np.zeros((4, 4), np.uint8)))
    for at in (0, 20, len(blob) - 20):
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            M.from_png(bytes(bad))
    with pytest.raises(ValueError):
        M.from_png(bytes(blob[:-6]))


def test_column(spark):
    long = "äbc " * 100_000
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "x" * 577), (5, long), (6, "same"), (6, "same"), (None, "é")]
    df = spark.createDataFrame([(*r, b"1") for r in rows], "doc_id long, text string, media binary")
    out = {r["doc_id"]: r for r in M.decode_column(M.encode_column(df)).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = out[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        assert len(r["feature"]) == 16
    assert out[1]["media_sha256"] == out[2]["media_sha256"]
    bad = spark.createDataFrame([(1, 0, b"junk"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r["feature"] for r in M.decode_column(bad).collect()] == [None, None]
    assert M.decode_column(M.encode_column(df.limit(0))).count() == 0


def test_like_images_have_like_hashes():
    rng = np.random.default_rng(3)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((16, 16))).astype(np.uint8)
    other = np.clip(image.astype(int) + rng.integers(-4, 5, image.shape), 0, 255).astype(np.uint8)
    bits = lambda h: bin(int(h, 16))
    assert bin(int(M.cosine_hash(image), 16) ^ int(M.cosine_hash(other), 16)).count("1") <= 6 and bits
