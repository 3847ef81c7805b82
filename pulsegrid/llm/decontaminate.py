"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case; runs of ASCII characters that are no letter or digit
become one space). An item of m bytes may differ in up to k = ``error_rate`` * m edits, so of its
k + 1 pieces at least one occurs unchanged. Every position of every text is looked up for a piece's
first bytes (8, or all of a shorter piece), then compared with the rest of it; windows around hits that
hold enough of the item's 4-grams for k edits (an edit spoils at most four) are verified with Myers'
bit-parallel distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekernel as bk
from .storage import drop, written

U = np.uint64
PIECE = 8
GRAM_BITS = 12
#: Bytes that one scan carries, with what an item takes beside its text; larger benchmarks are scanned in several blocks.
BLOCK_BYTES, ITEM_BYTES = 64 << 20, 1 << 10
#: Bytes of windows whose 4-grams are looked up at once.
FILTER_BYTES = 1 << 21
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = _WORD[128:] = True
_MAP = np.full(256, 0x20, np.uint8)
_MAP[_WORD] = bk.LOWER[_WORD]


@dataclass(frozen=True)
class MatchParams:
    error_rate: float = 0.1

    def __post_init__(self):
        if not 0 <= self.error_rate < 1:
            raise ValueError("error_rate must be in [0, 1)")


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the normalised texts of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, off = bk.buffers(pc.utf8_lower(column.cast(pa.large_string())))
    if not len(data):
        return data, off
    mapped = _MAP[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (mapped[1:] != 0x20) | (mapped[:-1] != 0x20)
    keep[off[:-1][off[:-1] < len(data)]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    return mapped[keep], upto[off]


def windows(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a little-endian integer; the last 7 positions are filled with zeros."""
    out = np.concatenate((data, np.zeros(PIECE, np.uint8))).astype(np.uint64)
    for n in (1, 2, 4):
        out = out[:-n] | out[n:] << U(8 * n)
    return out[: len(data)]


def gram_codes(data: np.ndarray) -> np.ndarray:
    """Hashed 4 bytes from every position."""
    quads = (windows(data) & U(0xFFFFFFFF)).astype(np.uint32)
    return (quads * np.uint32(2654435761) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


def edit_distance(pattern: bytes, text: bytes, limit: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any part of the text and where the first such part ends, if within ``limit``."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score, best, end = mask, 0, m, limit + 1, -1
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        ph = minus | ~(xh | plus) & mask
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        plus = mh | ~(xv | ph) & mask
        minus = ph & xv
    return (best, end) if best <= limit else None


class PieceIndex:
    """Pieces of items (id, text, repeats) by their first bytes."""

    def __init__(self, items: list[tuple[int | None, bytes, int]], params: MatchParams):
        self.items = items
        self.sizes = np.array([len(text) for _, text, _ in items], np.int64)
        self.budget = np.array([min(int(params.error_rate * len(text) + 1e-9), len(text) - 1) for _, text, _ in items], np.int64)
        heads: dict[int, list[tuple[int, int, int]]] = {}
        more: dict[int, list[list[tuple[int, int]]]] = {}
        for i, (_, text, _) in enumerate(items):
            m, k = len(text), int(self.budget[i])
            for p in range(k + 1):
                start, size = p * m // (k + 1), (p + 1) * m // (k + 1) - p * m // (k + 1)
                head = min(size, PIECE)
                heads.setdefault(head, []).append((int.from_bytes(text[start : start + head], "little"), i, start))
                more.setdefault(head, []).append([(at, int.from_bytes(text[start + at : start + at + PIECE], "little")) for at in (*range(PIECE, size - PIECE, PIECE), size - PIECE) if at > 0])
        self.heads = [HeadIndex(size, rows, more[size]) for size, rows in sorted(heads.items())]
        grams = np.zeros((len(items), (1 << GRAM_BITS) // 8), np.uint8)
        for i, (_, text, _) in enumerate(items):
            mine = np.zeros(1 << GRAM_BITS, bool)
            mine[gram_codes(np.frombuffer(text, np.uint8))[: max(0, len(text) - 3)]] = True
            grams[i] = np.packbits(mine, bitorder="little")
        self.grams = grams
        self.least = self.sizes - 3 - 4 * self.budget

    def _gram_filter(self, codes: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Indices of the windows that hold as many of their item's 4-grams as any match must."""
        out, ends = [], np.cumsum(np.maximum(high - low - 3, 0))
        at = 0
        while at < len(item):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FILTER_BYTES, "right")))
            i, n = item[at:upto], np.maximum((high - low)[at:upto] - 3, 0)
            code = codes[bk.ragged(low[at:upto], n)]
            held = self.grams[np.repeat(i, n), code >> 3] >> (code & 7).astype(np.uint8) & 1
            total = np.concatenate(([0], np.cumsum(held, dtype=np.int64)))
            stop = np.cumsum(n)
            out.append(at + np.flatnonzero(total[stop] - total[stop - n] >= self.least[i]))
            at = upto
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def search(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item index, distance, end, window start) of every item found in every text: the best match of each pair,
        the first of equally good ones."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        raw = data.tobytes()
        if not self.heads or not len(data):
            return []
        keys = windows(data)
        row, item, begin = (np.concatenate(x) for x in zip(*(h.hits(keys, off) for h in self.heads)))
        order = np.lexsort((begin, item, row))
        row, item, begin = row[order], item[order], begin[order]
        budget = self.budget[item]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > budget[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        row, item, low, high = row[first], item[first], begin[first], begin[last]
        low = np.maximum(off[row], low - self.budget[item])
        high = np.minimum(off[row + 1], high + self.sizes[item] + self.budget[item])
        likely = self._gram_filter(gram_codes(data), item, low, high)
        for r, i, lo, hi in zip(row[likely].tolist(), item[likely].tolist(), low[likely].tolist(), high[likely].tolist()):
            text, k = self.items[i][1], int(self.budget[i])
            if found.get((r, i), (1,))[0] == 0:
                continue
            limit = min(k, found[r, i][0] - 1) if (r, i) in found else k
            if hit := edit_distance(text, raw[lo:hi], limit):
                found[r, i] = (hit[0], lo + hit[1] - int(off[r]), lo - int(off[r]))
        return [(r, i, *v) for (r, i), v in sorted(found.items())]


class HeadIndex:
    """Pieces whose first ``size`` bytes (at most 8) are looked up, as (key, item, start in the item), and further places
    of each piece that must agree: (offset, 8 bytes), in as many rounds as the longest piece needs."""

    def __init__(self, size: int, rows: list[tuple[int, int, int]], more: list[list[tuple[int, int]]]):
        self.size = size
        keys = np.array([key for key, _, _ in rows], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.item, self.start = (np.array([r[k] for r in rows], np.int64)[order] for k in (1, 2))
        self.rounds = []
        for n in range(max(map(len, more), default=0)):
            at = np.array([x[n][0] if len(x) > n else 0 for x in more], np.int64)[order]
            key = np.array([x[n][1] if len(x) > n else 0 for x in more], np.uint64)[order]
            self.rounds.append((at, key))
        self.bits = max(16, min(24, int(len(keys) * 32).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def hits(self, windows: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, item and where the item would begin for every place at which a whole piece occurs."""
        heads = windows & _HEAD[self.size] if self.size < PIECE else windows
        at = np.flatnonzero(self.table[self._slot(heads)])
        k = np.minimum(np.searchsorted(self.keys, heads[at]), len(self.keys) - 1)
        real = self.keys[k] == heads[at]
        at, k = at[real], k[real]
        row = np.searchsorted(off, at, "right") - 1
        inside = at + self.size <= off[row + 1]
        at, k, row = at[inside], k[inside], row[inside]
        piece = bk.ragged(self.first[k], self.count[k])
        at, row = np.repeat(at, self.count[k]), np.repeat(row, self.count[k])
        for more_at, more_key in self.rounds:
            offset = more_at[piece]
            end = at + offset + PIECE
            same = (offset == 0) | ((end <= off[row + 1]) & (windows[np.minimum(end - PIECE, len(windows) - 1)] == more_key[piece]))
            at, row, piece = at[same], row[same], piece[same]
        return row, self.item[piece], at - self.start[piece]


def _named_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").groupBy("id", "text").agg(F.count(F.lit(1)).alias("n"))


def block_count(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 0) -> int:
    """How many blocks of ``block_bytes`` (default: BLOCK_BYTES) the items fill."""
    total = _named_items(benchmark, id_col, text_col).agg(F.sum(F.octet_length("text") + ITEM_BYTES)).first()[0] or 0
    return -(-int(total) // (block_bytes or BLOCK_BYTES))


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 0, n: int | None = None) -> Iterator[list[tuple[int | None, bytes, int]]]:
    """(id, normalised text, repeats) of all items in ``n`` blocks (default: ``block_count``); items whose normal form is empty are left out."""
    n = block_count(benchmark, id_col, text_col, block_bytes) if n is None else n
    named = _named_items(benchmark, id_col, text_col)
    for b in range(n):
        rows = (named if n == 1 else named.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)).collect()
        data, off = normalised(pa.array([r["text"] for r in rows], pa.string()))
        raw = data.tobytes()
        items = [(r["id"], raw[a:z].strip(), r["n"]) for r, a, z in zip(rows, off[:-1], off[1:])]
        yield sorted((x for x in items if x[1]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _scan(index: PieceIndex, texts: pa.Array) -> Iterator[tuple[int, int | None, int, int]]:
    """(row, item_id, distance, end) of a string column's texts, in bounded chunks."""
    n = len(texts)
    lengths = np.diff(bk.buffers(texts)[1])
    at = 0
    while at < n:
        upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), bk.CHUNK_BYTES, "right")))
        data, off = normalised(texts.slice(at, min(upto, n) - at))
        for row, item, distance, end, _ in index.search(data, off):
            for _ in range(index.items[item][2]):
                yield at + row, index.items[item][0], distance, end
        at = upto


def matches(docs: DataFrame, benchmark: DataFrame, params: MatchParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance (edits of the best match) and match_end (byte in the normalised text) of every
    document that holds an item within its error budget.

    Null and empty texts and items match nothing; repeated documents and items each give their row, those
    without an id a row with null. Of equally good matches the first counts. Other columns are ignored.
    A benchmark of several blocks is searched block by block: each one's matches are written and its index is
    destroyed before the next one is built, so driver and executors hold one block at a time.
    """
    params = params or MatchParams()
    spark, out, n = docs.sparkSession, None, block_count(benchmark)
    for items in item_blocks(benchmark, n=n):
        index = spark.sparkContext.broadcast(PieceIndex(items, params))  # at most BLOCK_BYTES of items

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), list(_scan(index.value, batch.column(1)))
                columns = [[ids[r] for r, *_ in rows], *([x[k] for x in rows] for k in (1, 2, 3))]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "match_end"])

        part = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, item_id long, distance long, match_end long")
        if n > 1:
            part = written(part, "matches")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, distance long, match_end long")


def without_matches(docs: DataFrame, benchmark: DataFrame, params: MatchParams | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; nothing is shuffled. What a block of several leaves is written, as in ``matches``."""
    params = params or MatchParams()
    spark, schema = docs.sparkSession, T.StructType(docs.schema.fields)
    at, n, ours = docs.columns.index(text_col), block_count(benchmark), []
    for items in item_blocks(benchmark, n=n):
        index = spark.sparkContext.broadcast(PieceIndex(items, params))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in _scan(index.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
        if n > 1:
            docs = written(docs, "unmatched")
            index.destroy()
            drop(*ours)
            ours = [docs]
    return docs
