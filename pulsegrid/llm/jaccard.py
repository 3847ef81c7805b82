"""Exact Jaccard self-join on word shingles, as components.

1. Texts become sets of shingle hashes; equal sets are one class from there on.
2. Counts of all documents' shingles in hashed counters mark common shingles. Any fixed set of marked
   shingles keeps the result exact; marking those that many documents share keeps candidates few.
3. Pigeonhole classes: two sets that link differ in at most k shingles, so in at most k unmarked ones.
   Shingles fall by hash into k + 1 + e segments, of which e + 1 at least have the same unmarked
   shingles in both sets; sets that share such a segment's signature are candidates of each other. A
   set with more than e segments without unmarked shingles also enters signatures of its whole
   segments: if all equal segments of a pair are of that kind, both sets do. Sizes are grouped so that
   partners lie in the same or the next group; a set is one node for each pair of groups it is in.
4. Candidate nodes' connected components are searched exactly: T-occurrence search over an inverted
   index of the component (DivideSkip: the short lists are merged by a heap that skips ahead, the
   long ones are probed by binary search), from every document to those not reached yet. Components
   of over MAX_GROUP nodes are cut into blocks, and pairs of blocks are searched.
5. Links found are joined into components once more.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekernel as bk
from .components import components
from .storage import drop, written

U = np.uint64
#: Shingles gathered in a map task before their signatures are sorted and linked.
FLUSH_SHINGLES = 1 << 18
#: Entries of short lists up to which a heap merges them.
HEAP_ENTRIES = 256
#: Nodes of a candidate component, and shingles of them, that one search is meant to hold.
MAX_GROUP, CELL_SHINGLES = 4096, 1 << 21
#: Parts over which rows of one key are spread before they meet a value of that key.
SALTS = 64
#: Ranges in which the counters of common shingles are summed, and their largest number as a power of two.
COUNTER_RANGES, COUNTER_BITS = 64, 22
#: Bytes of signatures that a bucket is meant to hold.
BUCKET_BYTES = 32 << 20


def need(size: int, percent: int) -> int:
    """Least overlap of a set of ``size`` with any partner."""
    return -(-percent * size // 100)


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


class Segments:
    """Size groups and numbers of segments for one threshold."""

    def __init__(self, percent: int, largest: int = 1 << 32):
        self.percent = percent
        bounds = [1]
        while len(bounds) < 3 or bounds[-3] <= largest:
            bounds.append(100 * bounds[-1] // percent + 1)
        self.bounds = np.array(bounds, np.int64)
        top = self.bounds[2:] - 1
        self.errors = (100 - percent) * top // percent
        self.spare = np.where(self.errors == 0, 0, 3 + -(-12 * self.errors // 100))
        self.count = self.errors + 1 + self.spare

    def group(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, sizes, "right") - 1

    def nodes(self, sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two nodes of every set (by its hash): for the pair of size groups that starts with its own, and the one before."""
        group = self.group(sizes).astype(np.uint64)
        return tuple(bk.mix(sets ^ bk.mix(group + U(2 - back))) for back in (0, 1))

    def signatures(self, shingles: np.ndarray, sizes: np.ndarray, nodes: tuple[np.ndarray, np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, node) for sets of distinct shingles that lie one behind the other; ``common`` marks shingles."""
        out, owner = [], []
        scrambled = bk.mix(shingles ^ U(0x5851F42D4C957F2D)) >> U(32)
        group = self.group(sizes)
        for back in (0, 1):
            inst = group - back
            ok = (inst >= 0) & (sizes > 0)
            for family in (0, 1):  # unmarked shingles, then whole segments
                m = np.where(ok, self.count[np.maximum(inst, 0)], 0)
                base = np.cumsum(m) - m
                rows = np.repeat(ok, sizes) & (~common if family == 0 else True)
                per = np.repeat(m, sizes)[rows].astype(np.uint64)
                seg = (scrambled[rows] * per >> U(32)).astype(np.int64) + np.repeat(base, sizes)[rows]
                total = int(m.sum())
                content = np.zeros(total, np.uint64)
                np.add.at(content, seg, shingles[rows])
                filled = np.bincount(seg, minlength=total) > 0
                who = np.repeat(np.arange(len(sizes)), m)
                over = np.bincount(who[~filled], minlength=len(sizes)) > self.spare[np.maximum(inst, 0)]
                # With at most `spare` empty segments one of the equal ones is filled; else the next family is
                # entered too, and in the last one the empty segments.
                keep = filled if family == 0 else filled | over[who]
                place = (((np.arange(total) - np.repeat(base, m)) * 4096 + np.repeat(inst, m)) * 2 + family).astype(np.uint64)
                out.append(bk.mix(content + bk.mix(place + U(0x632BE59BD9B4E019)))[keep])
                owner.append(nodes[back][who[keep]])
                ok = ok & over
                if not ok.any():
                    break
        return np.concatenate(out), np.concatenate(owner)


def distinct_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text one behind the other, how many each has, and two independent hashes of each set."""
    flat, counts = bk.word_shingles(data, off, width)
    parts, at = [], 0
    for n in counts.tolist():
        x = np.sort(flat[at : at + n])
        parts.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if n > 1 else x)
        at += n
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else flat
    ends = np.cumsum(sizes)
    hashes = []
    for salt in (U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bk.mix(bk.mix(flat + salt) ^ salt))))
        hashes.append(bk.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)))
    return flat, sizes, *hashes


def stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: indices of the smallest node of each key, and edges from the other nodes to it."""
    if not len(keys):
        return np.zeros(0, np.int64), nodes[:0], nodes[:0]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    low = np.minimum.reduceat(nodes, first)
    lead = np.repeat(low, np.diff(np.append(first, len(keys))))
    rest = nodes != lead
    edges = np.unique(np.stack((nodes[rest], lead[rest]), 1), axis=0) if rest.any() else np.zeros((0, 2), nodes.dtype)
    at = np.flatnonzero(~rest)
    return at[np.concatenate(([True], keys[at[1:]] != keys[at[:-1]]))], edges[:, 0], edges[:, 1]


class DivideSkipIndex:
    """Inverted index of sets for overlap queries. Shingles with the same list of sets are one weighted list."""

    def __init__(self, sets: list[np.ndarray], names: list[int]):
        self.names = np.array(names, np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
        self.shingles = flat[first]
        if not len(first):
            return
        codes = bk.mix(np.arange(1, len(sets) + 1).astype(np.uint64))
        kinds = np.add.reduceat(codes[owner], first)
        lengths = np.diff(np.append(first, len(flat)))
        _, pick, self.list_of = np.unique(kinds, return_index=True, return_inverse=True)
        self.lists = [owner[first[i] : first[i] + lengths[i]] for i in pick.tolist()]
        self.sizes = lengths[pick]

    def query(self, shingles: np.ndarray, least: int, wanted: np.ndarray) -> list[tuple[int, int]]:
        """(name, overlap) of every ``wanted`` set (a mask by name) that shares at least ``least`` (> 0) shingles."""
        if not len(self.shingles):
            return []
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        weights = np.bincount(self.list_of[at[self.shingles[at] == shingles]], minlength=len(self.lists))
        used = np.flatnonzero(weights)
        used = used[np.argsort(-self.sizes[used], kind="stable")]
        upto = np.cumsum(weights[used])
        if not len(used) or upto[-1] < least:
            return []
        # Long lists: as many as leave a threshold of at least 1 to the short ones, by DivideSkip's rule.
        longest = int(self.sizes[used[0]])
        n_long = int(np.searchsorted(upto, min(least - 1, least / (0.01 * max(longest, 2).bit_length() + 1)), "right"))
        n_long = min(n_long, len(used) - 1)
        long_weight = int(upto[n_long - 1]) if n_long else 0
        short = used[n_long:]
        who, count = self._merged([self.lists[i] for i in short.tolist()], weights[short], least - long_weight)
        keep = wanted[self.names[who]]
        who, count, left = who[keep], count[keep], long_weight
        for i in used[:n_long].tolist():
            if not len(who):
                return []
            entries, weight = self.lists[i], int(weights[i])
            count = count + weight * (entries[np.minimum(np.searchsorted(entries, who), len(entries) - 1)] == who)
            left -= weight
            keep = count + left >= least
            if not keep.all():
                who, count = who[keep], count[keep]
        return list(zip(self.names[who].tolist(), count.tolist()))

    def _merged(self, lists: list[np.ndarray], weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets whose weight over the short lists reaches ``least``: few entries by the heap, many by merging the
        sorted runs at once."""
        if sum(map(len, lists)) <= HEAP_ENTRIES:
            found = list(self._merge([(x.tolist(), w) for x, w in zip(lists, weights.tolist())], least))
            return np.array([w for w, _ in found], np.int64), np.array([c for _, c in found], np.int64)
        count = np.bincount(np.concatenate(lists), np.repeat(weights, [len(x) for x in lists]), minlength=len(self.names)).astype(np.int64)
        who = np.flatnonzero(count >= least)
        return who, count[who]

    @staticmethod
    def _merge(lists: list[tuple[list[int], int]], least: int) -> Iterator[tuple[int, int]]:
        """Heap merge of the lists' heads; heads that together cannot reach ``least`` skip to the next head."""
        heap = [(entries[0], k, 0) for k, (entries, _) in enumerate(lists)]
        heapq.heapify(heap)
        while heap:
            top, popped, weight = heap[0][0], [], 0
            while heap and heap[0][0] == top:
                item = heapq.heappop(heap)
                popped.append(item)
                weight += lists[item[1]][1]
            if weight >= least:
                yield top, weight
                target = top + 1
            else:
                while heap and weight + lists[heap[0][1]][1] < least:
                    item = heapq.heappop(heap)
                    popped.append(item)
                    weight += lists[item[1]][1]
                if not heap:
                    return
                target = heap[0][0]
            for _, k, at in popped:
                entries = lists[k][0]
                at = bisect_left(entries, target, at)
                if at < len(entries):
                    heapq.heappush(heap, (entries[at], k, at))


def link_groups(sets: list[np.ndarray], percent: int) -> list[int]:
    """Number of the group (its smallest index) of every set, by links of at least ``percent``."""
    n = len(sets)
    group, waiting, n_waiting = [-1] * n, np.ones(n, bool), n
    index, live = DivideSkipIndex(sets, list(range(n))), n
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed], n_waiting = False, n_waiting - 1
        group[seed], queue = seed, [seed]
        while queue and n_waiting:
            q = queue.pop()
            if not len(sets[q]):
                continue
            for other, both in index.query(sets[q], need(len(sets[q]), percent), waiting):
                if linked(len(sets[q]), len(sets[other]), both, percent):
                    waiting[other], n_waiting = False, n_waiting - 1
                    group[other] = seed
                    queue.append(other)
            if n_waiting and n_waiting * 2 <= live:
                names = np.flatnonzero(waiting).tolist()
                index, live = DivideSkipIndex([sets[i] for i in names], names), len(names)
    return group


def document_sets(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id and set_check (two hashes of the shingle set) and its two nodes for every row."""
    segments = Segments(percent)
    names = ["n_shingles", "set_id", "set_check", "node0", "node1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bk.buffers(batch.column(2))
            made = []
            for _, _, chunk, o in bk.chunks(data, off):
                _, n, s, check = distinct_sets(chunk, o, width)
                made.append((n, *(x.view(np.int64) for x in (s, check, *segments.nodes(s, n)))))
            columns = [np.concatenate(c) for c in zip(*made)] if made else [np.zeros(0, np.int64)] * 5
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, columns)], names=["doc_id", "text_hash", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{n} long" for n in names))


def text_hash(text: Column) -> Column:
    """Hash by which rows of one id are told apart."""
    return F.xxhash64(text.isNull(), text)


def slots(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (bk.mix(shingles + U(0x94D049BB133111EB)) >> U(64 - bits)).astype(np.int64)


def common_shingles(docs: DataFrame, width: int, total: int, text_col: str = "text") -> np.ndarray:
    """Marks, by counter, of shingles that many documents hold: counters over all documents (about 128 shingles
    each, at most 2 ** COUNTER_BITS, so the result is bounded) that lie 8 standard deviations over the mean."""
    bits = max(12, min(COUNTER_BITS, (int(total) // 128).bit_length()))
    per = (1 << bits) // COUNTER_RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n = np.zeros(1 << bits, np.int64), [], 0
        for batch in batches:
            data, off = bk.buffers(batch.column(0))
            for _, _, chunk, o in bk.chunks(data, off):
                held.append(slots(distinct_sets(chunk, o, width)[0], bits).astype(np.int32))
                n += len(held[-1])
                if n > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << bits)
        packed = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in counts.reshape(COUNTER_RANGES, per)]
        yield pa.record_batch([pa.array(np.arange(COUNTER_RANGES)), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of the ranges dealt to this task
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(zlib.decompress(packed.as_py()), "<u4")
                sums[part] = sums[part] + got if part in sums else got.astype(np.int64)
        packed = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array(packed, pa.binary())], names=["part", "counts"])

    # Partial counters stream through the task of their range, so one counter range is held however many tasks counted.
    sums = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "part long, counts binary").repartition("part").mapInArrow(add, "part long, counts binary")
    counts = np.zeros((COUNTER_RANGES, per), np.int64)
    for row in sums.collect():  # 2 ** bits counters
        counts[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
    mean = counts.mean()
    return (counts > mean + np.maximum(64, 8 * np.sqrt(mean))).ravel()


def candidate_edges(docs: DataFrame, width: int, percent: int, total: int, text_col: str = "text") -> DataFrame:
    """a, b: nodes that share a segment, as stars around the smallest one.

    Map tasks link what they hold and send one entry for each signature and flush, so a signature that
    very many sets share costs its bucket one entry a flush. Entries travel as packed sorted runs.
    """
    segments = Segments(percent)
    bits = max(6, (int(total) * 4 // BUCKET_BYTES).bit_length())
    entry = np.dtype([("low", "<u4"), ("mid", "<u2"), ("owner", "<u2")])
    marks = common_shingles(docs, width, total, text_col)
    mark_bits = len(marks).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))  # at most 2 ** COUNTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        marked = np.unpackbits(shared.value).astype(bool)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            flat, sizes, ids = (np.concatenate(x) for x in zip(*held))
            held = []
            ids, once = np.unique(ids, return_index=True)
            flat = flat[bk.ragged((np.cumsum(sizes) - sizes)[once], sizes[once])]
            sig, node = segments.signatures(flat, sizes[once], segments.nodes(ids, sizes[once]), marked[slots(flat, mark_bits)])
            order = np.argsort(sig)
            sig, node = sig[order], node[order]
            at, a, b = stars(sig, node)
            sig = sig[at]
            names, owner = np.unique(node[at], return_inverse=True)
            bucket = (sig >> U(64 - bits)).astype(np.int64)
            packed = np.empty(len(sig), entry)
            packed["low"], packed["mid"], packed["owner"] = sig & U(0xFFFFFFFF), (sig >> U(32)) & U(0xFFFF), owner
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            rows = ([], [], [])
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist()):
                part = packed[lo:hi].copy()
                who, part["owner"] = np.unique(part["owner"], return_inverse=True)
                rows[0].append(int(bucket[lo]))
                rows[1].append(names[who].astype("<u8").tobytes())
                rows[2].append(part.tobytes())
            if len(a):
                rows[0].append(-1 - int(bk.mix(a[:1])[0] >> U(64 - bits)))
                rows[1].append(a.astype("<u8").tobytes())
                rows[2].append(b.astype("<u8").tobytes())
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["bucket", "ids", "entries"])

        n = docs_held = 0
        for batch in batches:
            data, off = bk.buffers(batch.column(0))
            for lo, hi, chunk, o in bk.chunks(data, off):
                found = distinct_sets(chunk, o, width)
                some = found[1] > 0
                held.append((found[0], found[1][some], found[2][some]))
                n, docs_held = n + len(found[0]), docs_held + hi - lo
                if n >= FLUSH_SHINGLES or docs_held >= 1 << 14:
                    yield from flush()
                    n = docs_held = 0
        if held and n:
            yield from flush()

    def reduce(table: pa.Table) -> pa.Table:
        keys, nodes, a, b = [], [], [], []
        for bucket, ids, entries in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(2).to_pylist()):
            ids = np.frombuffer(ids, "<u8")
            if bucket < 0:
                a.append(ids)
                b.append(np.frombuffer(entries, "<u8"))
            else:
                packed = np.frombuffer(entries, entry)
                keys.append(packed["mid"].astype(np.uint64) << U(32) | packed["low"])
                nodes.append(ids[packed["owner"]])
        if keys:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.argsort(key, kind="stable")
            _, x, y = stars(key[order], node[order])
            a.append(x)
            b.append(y)
        pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), 1), axis=0) if a else np.zeros((0, 2), np.uint64)
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]).view(np.int64), "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64)})

    packed = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "bucket long, ids binary, entries binary")
    return packed.groupBy("bucket").applyInArrow(reduce, "a long, b long")


def verified_links(candidates: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: every set of (cell, key, set_id, text) by its set_id and the smallest one that links reach in its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, sets, names = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(names) < 2:
                return
            group = link_groups(sets, percent)
            low: dict[int, int] = {}
            for g, name in zip(group, names):
                low[g] = min(low.get(g, name), name)
            pairs = [(name, low[g]) for g, name in zip(group, names) if name != low[g]]
            if pairs:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])

        for batch in batches:
            data, off = bk.buffers(batch.column(3))
            comps, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, chunk, o in bk.chunks(data, off):
                flat, n, found, _ = distinct_sets(chunk, o, width)
                ends, found = np.cumsum(n), found.view(np.int64)
                for k, i in enumerate(range(lo, hi)):
                    if comps[i] != comp:
                        yield from close()
                        comp, sets, names = comps[i], [], []
                    if int(found[k]) == ids[i]:  # an id may come with several texts
                        sets.append(flat[ends[k] - n[k] : ends[k]].copy())
                        names.append(ids[i])
        yield from close()

    dealt = candidates.select("cell", "key", "set_id", "text").repartition("cell").sortWithinPartitions("cell", "key")
    return dealt.mapInArrow(run, "a long, b long")


def spread_join(rows: DataFrame, key: str, by: str, fold: Callable[[Column], Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``value`` folded (sum, min, ...) over all rows of one ``key`` as a column ``name``.

    A key may hold any share of the rows: they are dealt by the key and a salt from ``by``, and only the aggregates
    of the salts, SALTS a key at most, meet by the key alone.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    parts = salted.groupBy(key, "_salt").agg(fold(value).alias(name))
    whole = parts.groupBy(key).agg(fold(F.col(name)).alias(name))
    return salted.join(parts.select(key, "_salt").join(whole, key).hint("shuffle_merge"), [key, "_salt"]).drop("_salt")


def search_cells(members: DataFrame) -> DataFrame:
    """cell, no_id, key and set_id of (comp, no_id, key, set_id, n_shingles): one cell for each component, or one for each pair of
    its blocks if it has more nodes or shingles than one search holds."""
    weight = F.greatest(F.lit(1.0 / MAX_GROUP), F.col("n_shingles") / F.lit(float(CELL_SHINGLES)))
    sized = spread_join(members, "comp", "set_id", F.sum, weight, "load")
    at = sized.withColumn("blocks", F.ceil("load").cast("int")).withColumn("mine", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    other = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # With several blocks a block is searched together with every other one.
    useful = other.where("blocks = 1 or mine != other")
    return useful.select(F.xxhash64("comp", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "no_id", "key", "set_id")


def keyed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cell, key, set_id and text for wanted (no_id, key, set_id, cells): the texts of rows with that id, or, of rows without one, one text
    of that hash.

    Each wanted text is fetched once and travels with the list of its cells. The hints keep one plan at every size.
    """
    wanted = wanted.hint("shuffle_merge")
    named = docs.where("doc_id is not null").join(wanted.where("not no_id").withColumnRenamed("key", "doc_id"), "doc_id").select("cells", F.col("doc_id").alias("key"), "set_id", "text")
    # Copies without an id become one before they move, however many there are.
    nameless = docs.where("doc_id is null").groupBy(text_hash(F.col("text")).alias("key")).agg(F.min("text").alias("text"))
    others = nameless.join(wanted.where("no_id"), "key").select("cells", "key", "set_id", "text")
    return named.unionByName(others).select(F.explode("cells").alias("cell"), "key", "set_id", "text")


def labelled_rows(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and leads (whether the row's id, or without any id its hash, is the smallest of its component)
    of every row of (doc_id, text); see ``jaccard_components``."""
    sets = written(document_sets(docs, width, percent), "jaccard-sets")
    some = sets.where("n_shingles > 0")
    total = some.agg(F.sum("n_shingles")).first()[0]
    alone = sets.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("leads"))
    if total is None:
        return alone
    edges = written(candidate_edges(docs, width, percent, total), "jaccard-edges")
    comps = components(edges, "jaccard-components")
    classes = written(some.groupBy("n_shingles", "set_id", "set_check", "node0", "node1").agg(F.min("doc_id").alias("first_id"), F.min("text_hash").alias("first_hash")), "jaccard-classes")
    # A class's text is found by its first id, or by a hash of it if none of its rows has an id.
    nodes = classes.select(F.explode(F.array("node0", "node1")).alias("node"), F.col("first_id").isNull().alias("no_id"), F.coalesce("first_id", "first_hash").alias("key"), "set_id", "n_shingles")
    cells = written(search_cells(nodes.join(comps.withColumnRenamed("label", "comp"), "node").select("comp", "no_id", "key", "set_id", "n_shingles")), "jaccard-cells")
    drop(edges, comps)
    texts = keyed_texts(docs, cells.groupBy("no_id", "key", "set_id").agg(F.collect_set("cell").alias("cells")))
    links = written(verified_links(texts, width, percent), "jaccard-links")
    labels = components(links, "jaccard-labels")
    drop(cells, links)
    # The smallest id of every component of classes, or hash where none has an id; a class without links is one of its own.
    first = F.struct(F.col("first_id").isNull().alias("no_id"), F.coalesce("first_id", "first_hash").alias("key"))
    named = classes.select("set_id", "set_check", "n_shingles", first.alias("first"))
    linked_classes = named.join(labels.withColumnRenamed("node", "set_id"), "set_id")
    lowest = written(spread_join(linked_classes, "label", "set_id", F.min, F.col("first"), "lowest").select("set_id", "set_check", "n_shingles", "lowest"), "jaccard-lowest")
    groups = named.join(lowest, ["set_id", "set_check", "n_shingles"], "left").select("set_id", "set_check", "n_shingles", F.coalesce("lowest", "first").alias("lead"))
    component, no_id = F.when(~F.col("lead.no_id"), F.col("lead.key")), F.col("lead.no_id")
    leads = F.when(no_id, F.col("text_hash") == F.col("lead.key")).otherwise(F.coalesce(F.col("doc_id") == F.col("lead.key"), F.lit(False)))
    # A class of equal sets may hold any share of the rows: AQE splits its rows' side, a class has one row on the other.
    return some.join(groups, ["set_id", "set_check", "n_shingles"]).select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), leads.alias("leads")).unionByName(alone)


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Null texts and texts without words have no shingles and link with nothing: component_id is their
    own id. Rows of one id count as documents of their own that share it; so do rows without an id, which link like any
    and are never the smallest (a component of such rows alone has none). Sets are known by their sizes and two independent 64-bit hashes, shingles
    by one. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return labelled_rows(docs, width, percent).drop("text_hash", "leads")


def one_of_each_group(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that lead their group of ``jaccard_components``.

    Rows are judged one by one: of an id that comes with several texts only those go that follow another id. A row without an
    id goes if its group has a row with one; of a group of such rows alone the one of smallest text hash stays. Rows of one id
    and text count as one, which stays once.
    """
    rows = labelled_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width, percent)
    keys = {"_id": F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), "_hash": F.xxhash64(F.col("doc_id").isNull(), "text_hash")}
    others = rows.where("not leads").select(*[c.alias(k) for k, c in keys.items()]).distinct()
    known = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))).withColumn("_hash", F.xxhash64(F.col(id_col).isNull(), text_hash(F.col(text_col))))
    return known.join(others.hint("shuffle_merge"), ["_id", "_hash"], "left_anti").dropDuplicates(["_id", "_hash"]).select(*docs.columns)


def oracle_sql(width: int = 4, percent: int = 85) -> str:
    """DuckDB SQL for ``jaccard_components`` over documents: all pairs that share a shingle, and the links' closure."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with recursive split_words as (select row_number() over () as row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    sets as (select row_no, doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) end as s from split_words),
    sized as (select row_no, doc_id, len(s)::bigint as n from sets),
    held as (select row_no, unnest(s) as x from sets),
    shared as (select a.row_no as a, b.row_no as b, count(*) as k from held a join held b on a.x = b.x and a.row_no < b.row_no group by 1, 2),
    links as (select a, b from shared join sized p on p.row_no = a join sized q on q.row_no = b where 100 * k >= {percent} * (p.n + q.n - k)),
    edges as (select a, b from links union select b, a from links),
    reach(node, seen) as (select row_no, row_no from sized union select reach.node, edges.b from reach join edges on edges.a = reach.seen)
    select z.doc_id, z.n as n_shingles, c.component_id from sized z join (select node, min(doc_id) as component_id from reach join sized on row_no = seen group by 1) c on c.node = z.row_no
    """
