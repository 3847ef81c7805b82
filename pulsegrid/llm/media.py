"""PNG media columns: lossless storage, checked reading, and low-frequency cosine hashes.

``to_png``/``from_png`` handle 8-bit grey and RGB images without interlacing: chunks with CRC-32,
one zlib stream, and all five row filters.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Grey samples in a row of a payload's image, which is also the payload's unit.
ROW = 576
ZLIB_LEVEL = 4
_CHANNELS = {0: 1, 2: 3}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _guesses(flat: np.ndarray, bpp: int, kind: int) -> np.ndarray:
    """What row filter ``kind`` subtracts from every sample."""
    left, above, corner = (np.zeros_like(flat) for _ in range(3))
    left[:, bpp:], above[1:], corner[1:, bpp:] = flat[:, :-bpp], flat[:-1], flat[:-1, :-bpp]
    if kind < 3:
        return (np.zeros_like(flat), left, above)[kind]
    left, above, corner = (x.astype(np.int16) for x in (left, above, corner))
    if kind == 3:
        return ((left + above) // 2).astype(np.uint8)
    p = left + above - corner
    to_left, to_above, to_corner = np.abs(p - left), np.abs(p - above), np.abs(p - corner)
    return np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner)).astype(np.uint8)


def to_png(image: np.ndarray, filters: int | tuple[int, ...] = (0, 1, 2), level: int = ZLIB_LEVEL) -> bytes:
    """PNG of a uint8 image (height, width) or (height, width, 3).

    Every row takes of ``filters`` (0 none, 1 left, 2 above, 3 mean, 4 nearest of three) the one with the smallest sum
    of absolute signed differences, the first of equal ones.
    """
    height, width = image.shape[:2]
    bpp = 1 if image.ndim == 2 else image.shape[2]
    flat = np.ascontiguousarray(image, np.uint8).reshape(height, width * bpp)
    out, least = np.empty((height, width * bpp + 1), np.uint8), None
    for kind in (filters,) if isinstance(filters, int) else filters:
        rows = flat - _guesses(flat, bpp, kind)
        cost = np.abs(rows.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)
        at = np.ones(height, bool) if least is None else cost < least
        out[at, 0], out[at, 1:] = kind, rows[at]
        least = cost if least is None else np.minimum(cost, least)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if bpp == 1 else 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters: runs of rows with filters 0, 1 and 2 at once, runs with 3 and 4 by diagonals."""
    if kinds.size and not (0 <= kinds.min() and kinds.max() <= 4):
        raise ValueError("unknown row filter")
    out = np.empty_like(rows)
    height, width = rows.shape
    before = np.zeros(width, np.uint8)
    edges = np.flatnonzero(np.diff(np.where(kinds >= 3, 3, kinds))) + 1
    for a, b in zip(np.concatenate(([0], edges)).tolist(), np.concatenate((edges, [height])).tolist()):
        kind, part = int(kinds[a]), rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part.reshape(b - a, -1, bpp), axis=1, dtype=np.uint8).reshape(b - a, width)
        elif kind == 2:
            out[a:b] = np.cumsum(np.concatenate((before[None], part)), axis=0, dtype=np.uint8)[1:]
        else:
            out[a:b] = _by_diagonals(part, kinds[a:b], before, bpp)
        before = out[b - 1]
    return out


def _by_diagonals(rows: np.ndarray, kinds: np.ndarray, before: np.ndarray, bpp: int) -> np.ndarray:
    """Rows with filters 3 (mean) and 4 (nearest of three): pixels of one diagonal need only earlier ones, so each
    diagonal is undone at once."""
    n, pixels = len(rows), rows.shape[1] // bpp
    raw = rows.reshape(n, pixels, bpp).astype(np.int16)
    out = np.zeros((n + 1, pixels + 1, bpp), np.int16)  # with a row above and a column of zeros before
    out[0, 1:] = before.reshape(pixels, bpp)
    for d in range(n + pixels - 1):
        r = np.arange(max(0, d - pixels + 1), min(n, d + 1))
        i = d - r
        left, above, corner = out[r + 1, i], out[r, i + 1], out[r, i]
        p = left + above - corner
        to_left, to_above, to_corner = np.abs(p - left), np.abs(p - above), np.abs(p - corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        out[r + 1, i + 1] = raw[r, i] + np.where((kinds[r] == 3)[:, None], (left + above) // 2, nearest) & 255
    return out[1:, 1:].reshape(n, -1).astype(np.uint8)


def from_png(blob: bytes) -> np.ndarray:
    """Image of a PNG; ValueError if the signature, a chunk's checksum, a length or the kind is wrong."""
    if blob[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data = 8, None, []
    while True:
        if at + 12 > len(blob):
            raise ValueError("PNG ends within a chunk")
        (n,), kind = struct.unpack_from(">I", blob, at), blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(blob) or struct.unpack_from(">I", blob, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"wrong checksum or length of chunk {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[4:] != (0, 0, 0):
        raise ValueError("only 8-bit grey and RGB without interlacing")
    width, height, bpp = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width * bpp + 1):
        raise ValueError("pixel data has the wrong length")
    raw = raw.reshape(height, -1)
    out = _unfilter(np.ascontiguousarray(raw[:, 1:]), raw[:, 0].astype(np.int8), bpp)
    return out if bpp == 1 else out.reshape(height, width, bpp)


_side, _low = 32, 8
_basis = np.cos(np.pi * np.arange(_low)[:, None] * (2 * np.arange(_side) + 1) / (2 * _side))


def _means(rows: np.ndarray, n: int) -> np.ndarray:
    """n means of equal runs along the first axis; fewer rows than n are repeated."""
    height = len(rows)
    if height < n:
        return rows[np.arange(n) * height // n].astype(np.float64)
    edges = np.arange(n) * height // n
    return np.add.reduceat(rows.astype(np.float64), edges, axis=0) / np.diff(np.append(edges, height))[:, None]


def cosine_hash(image: np.ndarray) -> str:
    """64-bit hash as 16 hex digits: signs of the 8 x 8 lowest cosine terms of the 32 x 32 means against
    their median (the constant term left out of the median)."""
    grey = image if image.ndim == 2 else image.mean(2)
    small = _means(_means(grey, _side).T, _side).T
    terms = np.round(_basis @ small @ _basis.T, 6).ravel()
    bits = terms > np.median(terms[1:])
    return np.packbits(bits).tobytes().hex()


def payload_image(payload: bytes) -> np.ndarray:
    """Payload padded with bytes 255 to a positive multiple of ROW, as rows of grey samples."""
    padded = payload + b"\xff" * (-len(payload) % ROW if payload else ROW)
    return np.frombuffer(padded, np.uint8).reshape(-1, ROW)


MEDIA = "{0}, n_bytes long, media binary"


def _keyed(df: DataFrame, id_col: str) -> str:
    return f"`{id_col}` {df.schema[id_col].dataType.simpleString()}"


def encode_column(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes (of the UTF-8 text, null as empty) and media (a PNG with filtered rows) of every row; other columns are dropped."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [to_png(payload_image(t)) for t in texts]
                yield pa.record_batch([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(encode, MEDIA.format(_keyed(df, id_col)))


def decode_column(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored PNGs hold: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null or damaged image gives null in all but id and n_bytes, and in media_bytes and media_sha256
    what the damaged bytes give.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in (x.as_py() for x in batch.column(2)):
                size, sha = (None, None) if blob is None else (len(blob), hashlib.sha256(blob).hexdigest())
                try:
                    image = from_png(blob or b"")
                except (ValueError, zlib.error, struct.error):
                    rows.append((None, None, None, size, sha, None))
                    continue
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), size, sha, cosine_hash(image)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.select(id_col, "n_bytes", "media").mapInArrow(decode, f"{_keyed(df, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
