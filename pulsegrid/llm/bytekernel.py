"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

Texts of a batch lie one behind the other in one buffer; every kernel works on
that buffer with numpy, so the cost for each text is small and memory is
bounded by the size of a chunk (or of the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = (1 << 19) - 2
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_random = np.random.default_rng(20240229)
_SHINGLE_FACTORS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_LENGTH_CODES = _random.integers(1, 1 << 63, 65, dtype=np.uint64)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Spans of more bytes are hashed one by one in C, shorter ones eight bytes at a time over all spans.
LONG_SPAN = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, equal for equal contents wherever they lie.

    Eight bytes at a time are mixed into a state that is scrambled in between, so that no arithmetic relation
    between bytes carries over to the hash; spans of up to eight bytes and one length never share a hash.
    """
    sizes = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from every position
    out = mix(eights[starts] & _KEEP[np.minimum(sizes, 8)] ^ _LENGTH_CODES[np.minimum(sizes, LONG_SPAN)])
    more = np.flatnonzero((sizes > 8) & (sizes <= LONG_SPAN))
    for k in range(8, LONG_SPAN, 8):
        if not len(more):
            break
        part = eights[starts[more] + k] & _KEEP[np.minimum(sizes[more] - k, 8)]
        out[more] = mix((out[more] ^ part) * _U(_BASE) + _U(k))
        more = more[sizes[more] > k + 8]
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 20240229)
    return out


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of non-space bytes, none of which crosses texts, and how many each text has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = word & (edge[:-1] | np.concatenate(([True], ~word[:-1])))
    last = word & (edge[1:] | np.concatenate((~word[1:], [True])))
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words in each text (a shorter text: one run of all its words) and how many each has."""
    n_out = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if not len(hashes):
        return np.zeros(0, np.uint64), n_out
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    at = np.repeat(first - np.concatenate(([0], np.cumsum(n_out)[:-1])), n_out) + np.arange(n_out.sum())
    size = np.repeat(np.minimum(counts, width), n_out)
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    out = size.astype(np.uint64) * _U(_BASE)
    short = bool((size < width).any())
    for k in range(width):
        part = padded[at + k] * _SHINGLE_FACTORS[k]
        out += np.where(k < size, part, _U(0)) if short else part
    return mix(out), n_out


def word_shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lower-cased (A-Z) words, text by text, repeats included, and how many each text has."""
    starts, ends, counts = words(data, off)
    return shingles(span_hashes(LOWER[data], starts, ends), counts, width)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] - 1 of all i, one behind the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)
