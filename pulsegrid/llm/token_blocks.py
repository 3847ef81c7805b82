"""Token ids in files of patched frame-of-reference blocks.

A segment holds the ids of a run of documents::

    magic "PGTB", version u8, block length u16, documents u32, ids u64, ids before it in its part u64
    doc_id i64 x documents, doc_id present u8 x documents, ids of each document u64 x documents
    offsets of blocks from the first one u32 x (blocks + 1)
    blocks: minimum u32, width u8, exceptions u16, packed (id - minimum), positions u16, values u32

A block's width is the number of bits that ``PERCENTILE`` percent of its differences need; larger
differences are stored whole in the block's exception list and leave zero bits in the packed part.
Segments are binary values of a Parquet table, so they are committed by Spark's writer on any store.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytekernel as bk
from .storage import new_path

MAGIC = b"PGTB"
BLOCK = 512
PERCENTILE = 90
SEGMENT_IDS = 1 << 17
CACHE_WORDS = 1 << 18
JOINED_WORDS = 2000
HEADER = "<4sBHIQQ"
BLOCK_HEADER = np.dtype([("base", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def _lanes(b: int) -> list[tuple[int, int, int]]:
    """(lane, word, shift) of 64 values of ``b`` bits in ``b`` 64-bit words."""
    return [(j, j * b // 64, j * b % 64) for j in range(64)]


def _pack(values: np.ndarray, b: int) -> np.ndarray:
    """Rows of BLOCK uint32 values as rows of BLOCK / 8 * b bytes."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    out = np.zeros((b, lanes.shape[1]), np.uint64)
    for j, w, shift in _lanes(b):
        out[w] |= lanes[j] << np.uint64(shift)
        if shift + b > 64:
            out[w + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8", copy=False).view(np.uint8).reshape(len(values), -1)


def _unpack(packed: np.ndarray, b: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, b).T)
    out = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << b) - 1)
    for j, w, shift in _lanes(b):
        value = words[w] >> np.uint64(shift)
        if shift + b > 64:
            value = value | (words[w + 1] << np.uint64(64 - shift))
        out[j] = value & mask
    return np.ascontiguousarray(out.T).reshape(len(packed), BLOCK)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Offsets (blocks + 1) and bytes of the blocks of ``ids``; the last block is padded with its own minimum."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(1, np.int64), b""
    grid = np.empty(n_blocks * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[(n_blocks - 1) * BLOCK :].min()
    grid = grid.reshape(n_blocks, BLOCK)
    base = grid.min(1)
    diff = grid - base[:, None]
    rank = max(0, -(-BLOCK * PERCENTILE // 100) - 1)
    limit = np.partition(diff, rank, 1)[:, rank]
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.int64)
    out_of = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_exc = out_of.sum(1)
    sizes = BLOCK_HEADER.itemsize + width * (BLOCK // 8) + n_exc * 6
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(offsets[-1], np.uint8)
    head = np.zeros(n_blocks, BLOCK_HEADER)
    head["base"], head["width"], head["exceptions"] = base, width, n_exc
    out[offsets[:-1, None] + np.arange(BLOCK_HEADER.itemsize)] = head.view(np.uint8).reshape(n_blocks, -1)
    low = np.where(out_of, 0, diff).astype("<u4")
    for b in np.unique(width):
        if b:
            rows = np.flatnonzero(width == b)
            packed = _pack(low[rows], int(b))
            out[offsets[rows][:, None] + BLOCK_HEADER.itemsize + np.arange(packed.shape[1])] = packed
    row, at = np.nonzero(out_of)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    begin = offsets[row] + BLOCK_HEADER.itemsize + width[row] * (BLOCK // 8)
    out[(begin + 2 * nth)[:, None] + np.arange(2)] = at.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[(begin + 2 * n_exc[row] + 4 * nth)[:, None] + np.arange(4)] = diff[row, at].astype("<u4").view(np.uint8).reshape(-1, 4)
    return offsets, out.tobytes()


def unpack_blocks(raw: np.ndarray, offsets: np.ndarray, n_ids: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks ``first`` to ``last`` (exclusive, all by default), found by the index of block starts."""
    n_all = len(offsets) - 1
    last = n_all if last is None else last
    starts = offsets[first:last].astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = np.ascontiguousarray(raw[starts[:, None] + np.arange(BLOCK_HEADER.itemsize)]).view(BLOCK_HEADER).reshape(-1)
    diff = np.zeros((len(starts), BLOCK), np.uint32)
    width, n_exc = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    for b in np.unique(width):
        if b:
            rows = np.flatnonzero(width == b)
            packed = raw[starts[rows][:, None] + BLOCK_HEADER.itemsize + np.arange(b * (BLOCK // 8))]
            diff[rows] = _unpack(packed, int(b))
    row = np.repeat(np.arange(len(starts)), n_exc)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    begin = starts[row] + BLOCK_HEADER.itemsize + width[row] * (BLOCK // 8)
    at = np.ascontiguousarray(raw[(begin + 2 * nth)[:, None] + np.arange(2)]).view("<u2").reshape(-1)
    diff[row, at] = np.ascontiguousarray(raw[(begin + 2 * n_exc[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    ids = (diff + head["base"][:, None].astype(np.uint32)).reshape(-1)
    return ids[: n_ids - first * BLOCK] if last == n_all else ids


def pack_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    offsets, blocks = pack_blocks(ids)
    return b"".join((
        struct.pack(HEADER, MAGIC, 1, BLOCK, len(doc_ids), len(ids), before),
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
        np.asarray(counts, "<u8").tobytes(),
        offsets.astype("<u4").tobytes(),
        blocks,
    ))


def unpack_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """doc_ids, ids of each document, all ids, ids before this segment in its part."""
    magic, version, block, n_docs, n_ids, before = struct.unpack_from(HEADER, blob)
    if magic != MAGIC or version != 1 or block != BLOCK:
        raise ValueError("not a token block segment of this version")
    at = struct.calcsize(HEADER)
    doc_ids = np.frombuffer(blob, "<i8", n_docs, at)
    present = np.frombuffer(blob, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(blob, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    n_blocks = -(-n_ids // BLOCK)
    offsets = np.frombuffer(blob, "<u4", n_blocks + 1, at + 17 * n_docs)
    raw = np.frombuffer(blob, np.uint8, offset=at + 17 * n_docs + 4 * (n_blocks + 1))
    return [int(x) if p else None for x, p in zip(doc_ids, present)], counts, unpack_blocks(raw, offsets, n_ids), before


class _Odd(Exception):
    """A chunk whose words can't be known by themselves."""


class WordEncoder:
    """Encodes texts by their distinct words, with the ids that the tokenizer gives the whole texts.

    The byte-level pre-tokenizer always cuts before a space that a visible character follows, between
    a letter and ASCII punctuation, and around a line break between visible characters, so the ids of
    a text are those of the words between such places, one behind the other. Each distinct word goes
    through the tokenizer once, many of them joined by line breaks into one text whose ids are cut
    again by the known byte length of every id. Words are found by a hash and compared byte by byte.
    Texts that hold one of the tokenizer's added tokens, and chunks in which anything of this fails,
    go through the tokenizer whole.
    """

    #: Bytes that begin a visible character: no space, control, or white space outside ASCII.
    VISIBLE = np.ones(256, bool)
    VISIBLE[:0x21] = VISIBLE[0x7F] = False
    VISIBLE[[0xC2, 0xE1, 0xE2, 0xE3]] = False
    ALNUM = np.zeros(256, bool)
    ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
    LETTER = ALNUM.copy()
    LETTER[48:58] = False
    PUNCT = VISIBLE & ~ALNUM
    PUNCT[0x80:] = False

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)  # one character stands for one byte
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int32)
        self.text = np.zeros(0, np.uint8)
        self.text_starts = np.zeros(0, np.int64)
        self.text_sizes = np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keep the half of the cache that the most chunks used."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE_WORDS // 2])
        sizes, lengths = self.sizes[keep], self.text_sizes[keep]
        self.ids = self.ids[bk.ragged(self.starts[keep], sizes)]
        self.text = self.text[bk.ragged(self.text_starts[keep], lengths)]
        self.keys, self.starts, self.sizes, self.uses = self.keys[keep], np.cumsum(sizes) - sizes, sizes, self.uses[keep] // 2
        self.text_starts, self.text_sizes = np.cumsum(lengths) - lengths, lengths

    def cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """True at i if the pre-tokenizer is sure to cut before byte i, or a text begins or ends there."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) < 3:
            cut[off] = True
            return cut
        visible = self.VISIBLE[data]
        cut[: len(data) - 1] = (data[:-1] == 0x20) & visible[1:]
        latin = (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        cut[2 : len(data)] |= (self.LETTER[data[1:-1]] | latin) & self.PUNCT[data[2:]]
        lone = (data[1:-1] == 0x0A) & visible[2:] & visible[:-2] & (data[:-2] < 0x80)
        cut[1 : len(data) - 1] |= lone
        cut[2 : len(data)] |= lone
        cut[np.maximum(off[1:] - 1, 0)] = False  # what follows a text's last byte is another text's
        cut[off] = True
        return cut

    def learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """Words that begin (after one space) and end with visible ASCII or letters may be joined by line breaks."""
        visible = self.VISIBLE
        joins = [visible[p[-1]] and (visible[p[0]] or len(p) > 1 and p[0] == 0x20 and visible[p[1]]) for p in parts]
        order = np.argsort(~np.array(joins, bool), kind="stable")
        n_joined = int(np.count_nonzero(joins))
        groups = [order[i : min(i + JOINED_WORDS, n_joined)] for i in range(0, n_joined, JOINED_WORDS)] + [order[i : i + 1] for i in range(n_joined, len(order))]
        keys_in, starts, sizes, found, base = [], [], [], [], len(self.ids)
        for g in groups:
            text = b"\n".join([parts[i] for i in g.tolist()]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            token_ends = np.cumsum(self.lengths[ids])
            size = np.array([len(parts[i]) for i in g.tolist()], np.int64)
            end = np.cumsum(size + 1) - 1
            first, last = np.searchsorted(token_ends, end - size, "right"), np.searchsorted(token_ends, end, "right")
            if len(ids) and not (np.array_equal(token_ends[last - 1], end) and token_ends[-1] == end[-1]):
                raise _Odd
            keys_in.append(keys[g])
            starts.append(base + first)
            sizes.append(last - first)
            found.append(ids)
            base += len(ids)
        keys = np.concatenate((self.keys, *keys_in))
        by = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.sizes = keys[by], np.concatenate((self.starts, *starts))[by], np.concatenate((self.sizes, *sizes))[by]
        self.uses = np.concatenate((self.uses, np.zeros(len(keys) - len(self.uses), np.int32)))[by]
        self.ids = np.concatenate((self.ids, *found))
        lengths = np.array([len(parts[i]) for g in groups for i in g.tolist()], np.int64)
        text = np.frombuffer(b"".join([parts[i] for g in groups for i in g.tolist()]), np.uint8)
        self.text_starts = np.concatenate((self.text_starts, len(self.text) + np.cumsum(lengths) - lengths))[by]
        self.text_sizes, self.text = np.concatenate((self.text_sizes, lengths))[by], np.concatenate((self.text, text))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and how many each has."""
        special = self._with_added(data, off)
        edges = np.unique(np.concatenate(([0], special, special + 1, [len(off) - 1])))
        ids, counts = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
            try:
                got = self._plain(part, o) if a in special else self._by_words(part, o)
            except _Odd:
                got = self._plain(part, o)
            ids.append(got[0])
            counts.append(got[1])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _with_added(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows of the texts that hold an added token's string."""
        rows, raw = set(), data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                if at + len(token) <= off[row + 1]:
                    rows.add(row)
                    at = raw.find(token, int(off[row + 1]))
                else:
                    at = raw.find(token, at + 1)
        return np.array(sorted(rows), np.int64)

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, ids, counts = data.tobytes(), [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            ids.append(np.array(self.tokenizer.encode_batch_fast([raw[a:b].decode()], add_special_tokens=False)[0].ids, np.uint32))
            counts.append(len(ids[-1]))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _by_words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import pandas as pd

        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        bounds = np.flatnonzero(self.cuts(data, off))
        starts, ends = bounds[:-1], bounds[1:]
        codes, keys = pd.factorize(bk.span_hashes(data, starts, ends))
        keys = np.asarray(keys, np.uint64)
        first = np.empty(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        lengths = ends - starts
        if not np.array_equal(lengths[first][codes], lengths) or not np.array_equal(data[bk.ragged(starts[first][codes], lengths)], data):
            raise _Odd  # two words of this chunk share a hash
        if len(self.keys) > CACHE_WORDS:
            self.trim()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        old, here = at[known], first[known]
        if not np.array_equal(self.text_sizes[old], lengths[here]) or not np.array_equal(self.text[bk.ragged(self.text_starts[old], self.text_sizes[old])], data[bk.ragged(starts[here], lengths[here])]):
            raise _Odd  # a word shares its hash with another one in the cache
        missing = np.flatnonzero(~known)
        if len(missing):
            raw = data.tobytes()
            self.learn(keys[missing], [raw[starts[i] : ends[i]] for i in first[missing]])
            at = np.searchsorted(self.keys, keys)
        self.uses[at] += 1
        word = at[codes]
        sizes = self.sizes[word]
        ids = self.ids[bk.ragged(self.starts[word], sizes)]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        counts = np.diff(upto[np.searchsorted(starts, off)])
        covered = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        if not np.array_equal(covered[np.concatenate(([0], np.cumsum(counts)))], off):
            raise _Odd
        return ids, counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


SEGMENT_SCHEMA = "part int, seq int, n_docs long, n_ids long, segment binary"


def write_segments(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write segments in ascending order of ``id_col``.

    Null texts count as empty (just the end id), null ids come first, equal ids are ordered by text;
    other columns are ignored. An empty table writes no segment.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        names, counts, parts, n, before, seq = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, counts, parts, n, before, seq
            blob = pack_segment(names, np.concatenate(counts), np.concatenate(parts), before)
            row = [[part], [seq], [len(names)], [n], [blob]]
            before, seq = before + n, seq + 1
            names, counts, parts, n = [], [], [], 0
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "n_docs", "n_ids", "segment"])

        for batch in batches:
            data, off = bk.buffers(batch.column(1))
            for lo, hi, chunk, o in bk.chunks(data, off):
                ids, sizes = enc.encode(chunk, o)
                ends = np.cumsum(sizes)
                names += batch.column(0).slice(lo, hi - lo).to_pylist()
                counts.append(sizes + 1)
                parts.append(np.insert(ids, ends, end_id))
                n += len(ids) + hi - lo
                if n >= SEGMENT_IDS:
                    yield flush()
        if names:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path)


def read_segments(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of int) of every document, decoded from the segments."""
    return _read(spark, path, True)


def _read(spark, path: str, with_ids: bool) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, counts, ids, before = unpack_segment(blob.as_py())
                ends = np.cumsum(counts)
                little = ids.astype("<u4", copy=False)
                raw = little.tobytes()
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(before + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(little.astype(np.int32))))
                yield pa.record_batch(columns, names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    docs = files.select("part", "segment").mapInArrow(decode, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    # One row for each part, that is for each task of the writing stage: bounded by the number of partitions.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    out = docs.join(F.broadcast(before), "part")
    return out.select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids in block files in the shared folder and return what reading them gives:
    doc_id, start, n_tokens, ids_crc32 (unsigned crc32 of the ids as little-endian 32-bit integers)."""
    path = new_path(docs.sparkSession, "token-blocks")
    write_segments(docs, path, tokenizer_path, end_id)
    return _read(docs.sparkSession, path, False)
