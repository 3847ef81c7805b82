"""Collocations: phrases of two to five words whose parts meet more often than by chance.

Every shard of a task's texts becomes one sequence of word ids. Prefix doubling in numpy sorts its suffixes as far as a
phrase reaches; runs of suffixes with a common prefix of n words (LCP intervals) are the n-grams and their counts. Spark
adds up the shards' counts by language and phrase, and scores what is frequent.

A phrase is no more frequent than any part of it. So three earlier passes count words, then pairs, then triples of words, in hashed
buckets; shards report no n-gram that holds a word, pair or triple whose bucket stays below the least count, and no word that
is in no frequent pair, as only parts of phrases are looked up. A filter is one
bit a bucket, of a size that doesn't grow with the data, and lets whole buckets pass: it spares work and never changes a count.

A phrase is sent by each task that holds it. So phrases are counted by a few tasks a core, however large the input is: frequent
phrases, and with them the rows that are sent, then grow no faster than the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytekernel as bk
from .storage import written

UNKNOWN = "und"
#: Words of one suffix array, and of one piece of bytes that is cut into words at once.
SHARD_WORDS, PIECE_BYTES = 1 << 20, 1 << 22
#: Bucket counts, and phrase counts, that a task gathers before it sends them on.
GATHERED, GATHERED_PHRASES = 1 << 22, 1 << 19
#: Entries that become rows of one batch at once, but that a bucket's stay together.
SENT = 1 << 16
#: Tasks a core that count phrases.
TASKS = 2
#: First ranking by salted keys, so that no task sees all phrases of a language.
SALTS = 64

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_PIECE_END
_WORD[[0x20, 0x09]] = False


@dataclass(frozen=True)
class PhraseParams:
    """``bits``: log2 of the buckets of each of the three filters (2 ** bits / 8 bytes, held by every task)."""

    longest: int = 5
    min_count: int = 100
    top: int = 2000
    scale: int = 1000
    bits: int = 26

    def __post_init__(self):
        if not 2 <= self.longest <= 8 or self.min_count < 1 or self.top < 1 or self.scale < 1 or not 15 <= self.bits <= 31:
            raise ValueError("longest in [2, 8], bits in [15, 31], min_count, top and scale positive")


@dataclass
class Sequence:
    """Words of a piece of a batch: ``ids`` into (language, word) pairs (-1: a cut), ``hashes`` of those pairs."""

    ids: np.ndarray
    hashes: np.ndarray
    langs: pa.Array
    words: pa.Array

    def with_ids(self, ids: np.ndarray) -> Sequence:
        return Sequence(ids, self.hashes, self.langs, self.words)


def _distinct(codes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes below ``bound`` and every code's place among them."""
    if bound > 4 * len(codes) + 1024:
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(bound, bool)
    seen[codes] = True
    place = np.cumsum(seen) - 1
    return np.flatnonzero(seen), place[codes]


def sequences(batch: pa.RecordBatch) -> Iterator[Sequence]:
    """Texts (column 1) of languages (column 0) as word ids with a cut before each piece; ASCII capitals are lowered."""
    langs = pc.dictionary_encode(pc.fill_null(batch.column(0).cast(pa.string()), UNKNOWN))
    lang_of_row, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
    name_bytes, name_off = bk.buffers(names)
    lang_hash = bk.span_hashes(name_bytes, name_off[:-1], name_off[1:]) if len(names) else np.zeros(0, np.uint64)
    data, off = bk.buffers(batch.column(1))
    for lo, _, raw, o in bk.chunks(data, off, PIECE_BYTES):
        s = _sequence(raw, o, lang_of_row[lo:], names, lang_hash)
        if s is not None:
            yield s


def _sequence(raw: np.ndarray, o: np.ndarray, lang_of_row: np.ndarray, names: pa.Array, lang_hash: np.ndarray) -> Sequence | None:
    """The texts that begin at ``o`` in the bytes ``raw``; a function of its own, so that its arrays end before others use the words."""
    if not len(raw):
        return None
    word = _WORD[raw]
    text_start = np.zeros(len(raw) + 1, bool)
    text_start[o] = True
    first = word & (text_start[:-1] | np.concatenate(([True], ~word[:-1])))
    starts = np.flatnonzero(first)
    if not len(starts):
        return None
    last = word & (text_start[1:] | np.concatenate((~word[1:], [True])))
    sizes = np.flatnonzero(last) + 1 - starts
    piece = np.cumsum(_PIECE_END[raw], dtype=np.int32)[starts]
    row = np.searchsorted(o, starts, "right") - 1
    opens = np.concatenate(([True], (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])))
    packed = pa.py_buffer(bk.LOWER[raw[word]])
    ends = pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
    coded = pa.LargeStringArray.from_buffers(len(starts), ends, packed).dictionary_encode()
    words, language = coded.dictionary, lang_of_row[row].astype(np.int64)
    pairs, ids = _distinct(language * len(words) + coded.indices.to_numpy(), len(names) * len(words))
    word_bytes, word_off = bk.buffers(words)
    hashes = bk.span_hashes(word_bytes, word_off[:-1], word_off[1:])
    pair_lang, pair_word = pairs // len(words), pairs % len(words)
    spaced = np.full(len(ids) + int(opens.sum()), -1, np.int64)
    spaced[np.arange(len(ids)) + np.cumsum(opens)] = ids
    return Sequence(spaced, bk.mix(hashes[pair_word] ^ bk.mix(lang_hash[pair_lang] + np.uint64(1))), names.take(pa.array(pair_lang)), words.take(pa.array(pair_word)))


def pair_hashes(s: Sequence, at: np.ndarray) -> np.ndarray:
    """Hashes of the two words that begin at each place."""
    return bk.mix(s.hashes[s.ids[at]] * np.uint64(0x9E3779B97F4A7C15) ^ s.hashes[s.ids[at + 1]])


def triple_places(s: Sequence) -> np.ndarray:
    """Places where three words stand without a cut between them."""
    return np.flatnonzero((s.ids[:-2] >= 0) & (s.ids[1:-1] >= 0) & (s.ids[2:] >= 0))


def triple_hashes(s: Sequence, at: np.ndarray) -> np.ndarray:
    return bk.mix(pair_hashes(s, at) * np.uint64(0xC2B2AE3D27D4EB4F) ^ s.hashes[s.ids[at + 2]])


class Filter:
    """Which buckets reach the least count; every bucket does where there is no filter yet."""

    def __init__(self, bits: int, parts: list[tuple[int, bytes]] | None = None):
        self.shift = np.uint64(64 - bits)
        self.set = None
        if parts is not None:
            self.set = np.zeros(1 << bits >> 3, np.uint8)
            for number, part in parts:
                self.set[number * 4096 : (number + 1) * 4096] = np.frombuffer(part, np.uint8)[: len(self.set) - number * 4096]

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        if self.set is None:
            return np.ones(len(hashes), bool)
        b = self.bucket(hashes)
        return (self.set[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def without_rare_words(s: Sequence, words: Filter) -> Sequence:
    kept = np.append(words.passes(s.hashes), True)  # a cut (-1) stays a cut
    return s.with_ids(np.where(kept[s.ids], s.ids, -1))


def pair_places(s: Sequence) -> np.ndarray:
    """Places where two words stand without a cut between them."""
    return np.flatnonzero((s.ids[:-1] >= 0) & (s.ids[1:] >= 0))


def joined_runs(s: Sequence, pairs: Filter) -> Sequence:
    """Runs of words in which every two neighbours are a pair that passes, each with a cut before it; single words are left out."""
    at = pair_places(s)
    at = at[pairs.passes(pair_hashes(s, at))]
    follows, leads = np.zeros(len(s.ids), bool), np.zeros(len(s.ids), bool)
    follows[at + 1] = True
    leads[at] = True
    word = follows | leads
    opens = word & ~follows
    ids = np.full(int(word.sum() + opens.sum()), -1, np.int64)
    ids[(np.cumsum(word) - 1 + np.cumsum(opens))[word]] = s.ids[word]
    return s.with_ids(ids)


def _bucket_sums(entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """bucket and n of entries that hold a bucket in their upper 32 bits and a count in their lower ones; sorts ``entries``."""
    entries.sort()
    half, low, lo = np.uint64(32), np.uint64((1 << 32) - 1), 0
    while lo < len(entries):
        hi = int(np.searchsorted(entries, entries[min(lo + SENT, len(entries)) - 1] | low, "right"))
        buckets = entries[lo:hi] >> half
        heads = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
        n = np.add.reduceat((entries[lo:hi] & low).astype(np.int64), heads)
        yield pa.record_batch([pa.array(buckets[heads].astype(np.int64)), pa.array(n)], names=["bucket", "n"])
        lo = hi


def _bucket_counts(docs: DataFrame, hashes_of: Callable[[Sequence], list[tuple[np.ndarray, np.ndarray | None]]], params: PhraseParams, kinds: int = 1) -> list[Filter]:
    """Add up counts by bucket and keep the buckets of ``min_count`` or more as bits, for each of ``kinds`` lists of hashes (and their
    counts, by default 1)."""
    bits = params.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            entries = np.concatenate(gathered)
            gathered.clear()
            return _bucket_sums(entries)

        sieve = Filter(bits)
        for batch in batches:
            for s in sequences(batch):
                for kind, (hashes, n) in enumerate(hashes_of(s)):
                    entries = (sieve.bucket(hashes) | kind << bits).astype(np.uint64) << np.uint64(32)
                    entries |= np.uint64(1) if n is None else n.astype(np.uint64)
                    gathered.append(entries)
                    size += len(entries)
                del hashes, n, entries
                if size >= GATHERED:
                    yield from flush()
                    size = 0
        if gathered:
            yield from flush()

    sums = docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= params.min_count)
    # The bit functions count from 1: values 1 to 32768 are the bits of part 1.
    parts = sums.groupBy(F.expr("bitmap_bucket_number(bucket + 1)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bucket + 1))").alias("set"))
    found, each = [(r["part"] - 1, bytes(r["set"])) for r in parts.collect()], 1 << bits - 15  # 2 ** bits / 8 bytes a kind at most
    return [Filter(bits, [(number % each, part) for number, part in found if number // each == kind]) for kind in range(kinds)]


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``ids`` by their first ``depth`` values or more, and how many each shares with the one before it
    (LCP, at most ``depth``). Prefix doubling: ranks by 2h values come from pairs of ranks by h values, h apart.
    """
    n = len(ids)
    ranks, h = [ids + 2], 1  # 0: behind the end, 1: a cut
    order = np.argsort(ranks[0], kind="stable")
    while h < depth:
        r = ranks[-1]
        key = r * (int(r.max()) + 2)
        key[: max(0, n - h)] += r[h:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.concatenate(([1], key[1:] != key[:-1])))
        ranks.append(dense)
        h *= 2
    lcp, a, b = np.zeros(n, np.int64), order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):  # equal ranks by h values: h more are shared
        r = np.append(ranks[k], [-1, -2])
        same = r[np.minimum(a, n)] == r[np.minimum(b, n + 1)]
        step = same.astype(np.int64) << k
        lcp[1:] += step
        a += step
        b += step
    return order, np.minimum(lcp, depth)


def _run_lengths(holds: np.ndarray) -> np.ndarray:
    """How many places in a row hold, from each one on."""
    at = np.arange(len(holds))
    ends = np.flatnonzero(np.append(~holds, True))
    return ends[np.searchsorted(ends, at)] - at


def grams(ids: np.ndarray, longest: int, counted: int, triples: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, one place of each n-gram, its count) for n from 2: n-grams without a cut that begin at the first ``counted`` places, of
    which all three words in a row begin at places of ``triples`` (default: any)."""
    n_ids = len(ids)
    if not n_ids:
        return
    order, lcp = suffix_array(ids, longest)
    left = _run_lengths(ids >= 0)
    if triples is not None:
        left = np.minimum(left, np.maximum(_run_lengths(triples) + 2, 2))
    left = left[order]
    counts = (order < counted).astype(np.int64)
    for n in range(2, longest + 1):
        heads = np.flatnonzero(lcp < n)  # intervals: all suffixes in one share n values
        total = np.add.reduceat(counts, heads)
        whole = (left[heads] >= n) & (total > 0)  # equal n-grams have equal words, so these hold for all of an interval
        yield n, order[heads[whole]], total[whole]


class Gathered:
    """Phrase counts of a task's shards, added up until they are many different ones."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.parts.append(pa.Table.from_batches([batch]))
        self.rows += batch.num_rows
        if self.rows >= GATHERED_PHRASES:
            self._merge()
            if self.rows >= GATHERED_PHRASES // 2:
                yield from self.flush()

    def _merge(self) -> None:
        merged = pa.concat_tables(self.parts).group_by(["lang", "n", "phrase"]).aggregate([("f", "sum")])
        self.parts = [merged.rename_columns(["lang", "n", "phrase", "f"])]
        self.rows = merged.num_rows
        pa.default_memory_pool().release_unused()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            yield from self.parts[0].combine_chunks().to_batches(max_chunksize=1 << 16)
        self.parts, self.rows = [], 0


def shard_counts(docs: DataFrame, words: Filter, pairs: Filter, triples: Filter, params: PhraseParams) -> DataFrame:
    """lang, n, phrase, f of every n-gram that the filters leave in the shards of each task; n = 0: how many words of a language in all.
    ``words``: those that frequent pairs hold."""
    spark = docs.sparkSession
    docs = docs.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast((words, pairs, triples))  # three times 2 ** bits / 8 bytes
    longest = params.longest

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_pair, by_triple = shared.value

        def rows(s: Sequence, n: int, at: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            parts = [s.words.take(pa.array(s.ids[at + k])) for k in range(n)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
            return pa.record_batch([s.langs.take(pa.array(s.ids[at])), pa.array(np.full(len(at), n, np.int32)), phrase.cast(pa.string()), pa.array(f)], names=["lang", "n", "phrase", "f"])

        gathered = Gathered()
        for batch in batches:
            for s in sequences(batch):
                seen = np.bincount(s.ids[s.ids >= 0], minlength=len(s.hashes))
                langs = s.langs.dictionary_encode()
                total = np.bincount(langs.indices.to_numpy(), seen, minlength=len(langs.dictionary)).astype(np.int64)
                yield from gathered.add(pa.record_batch([langs.dictionary, pa.array(np.zeros(len(total), np.int32)), pa.array([""] * len(total)), pa.array(total)], names=["lang", "n", "phrase", "f"]))
                common = np.flatnonzero(by_word.passes(s.hashes) & (seen > 0))
                yield from gathered.add(rows(s.with_ids(common), 1, np.arange(len(common)), seen[common]))
                s = joined_runs(without_rare_words(s, by_word), by_pair)
                triples = np.zeros(len(s.ids), bool)
                at = triple_places(s)
                triples[at[by_triple.passes(triple_hashes(s, at))]] = True
                for a in range(0, len(s.ids), SHARD_WORDS):
                    whole = slice(a, a + SHARD_WORDS + longest - 1)
                    part = s.with_ids(s.ids[whole])
                    for n, at, f in grams(part.ids, longest, SHARD_WORDS, triples[whole]):
                        if len(at):
                            yield from gathered.add(rows(part, n, at, f))
        yield from gathered.flush()

    return docs.mapInArrow(count, "lang string, n int, phrase string, f long")


def frequent_phrases(docs: DataFrame, params: PhraseParams | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, n, phrase, f of all phrases of 2 to ``longest`` words with f >= min_count, of their words (and a few others), and of all
    languages (n = 0): written."""
    params = params or PhraseParams()
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def of_words(s: Sequence):
        seen = np.bincount(s.ids[s.ids >= 0], minlength=len(s.hashes))
        return [(s.hashes, seen)]

    (words,) = _bucket_counts(texts, of_words, params)
    known = texts.sparkSession.sparkContext.broadcast(words)

    def of_pairs(s: Sequence):
        s = without_rare_words(s, known.value)
        return [(pair_hashes(s, pair_places(s)), None)]

    (pairs,) = _bucket_counts(texts, of_pairs, params)
    both = texts.sparkSession.sparkContext.broadcast((words, pairs))

    def of_triples(s: Sequence):
        by_word, by_pair = both.value
        s = joined_runs(without_rare_words(s, by_word), by_pair)
        seen = np.bincount(s.ids[s.ids >= 0], minlength=len(s.hashes))  # a word of a frequent pair is there as often as the pair at least
        return [(triple_hashes(s, triple_places(s)), None), (s.hashes[seen > 0], seen[seen > 0])]

    triples, paired = _bucket_counts(texts, of_triples, params, 2)
    counts = shard_counts(texts, paired, pairs, triples, params).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    out = written(counts.where((F.col("f") >= params.min_count) | (F.col("n") == 0)), "phrases")
    known.unpersist()
    both.unpersist()
    return out


def scored(frequent: DataFrame, params: PhraseParams) -> DataFrame:
    """lang, phrase, m (words), a, l, r, n, score of every candidate at its lowest-scoring cut.

    Decimals of 38 digits hold scale * a * n and l * r exactly up to 10 ** 17 words.
    """
    cut = F.sequence(F.lit(1), F.col("m") - 1)
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = frequent.where("n >= 2").select("lang", "phrase", F.col("n").alias("m"), F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cuts.select("*", F.explode(cut).alias("k")).select("lang", "phrase", "m", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    side = lambda key, f: frequent.where("n >= 1").select("lang", F.col("phrase").alias(key), F.col("f").alias(f))
    total = frequent.where("n = 0").select("lang", F.col("f").alias("n"))
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(total, "lang")
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast({params.scale} as decimal(5, 0)) * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    best = both.groupBy("lang", "phrase", "m", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "m", "a", "best.l", "best.r", "n", "best.score")


def not_within_equals(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """Candidates that lie in no longer candidate as frequent as they are. Between a phrase and one that holds it as often lies
    one a word longer that does too, so only those are looked at."""
    w = F.split("phrase", " ")
    longer = frequent.where("n >= 3").select("lang", "f", F.explode(F.array(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1))).alias("w"))
    held = longer.select("lang", F.col("f").alias("a"), F.array_join("w", " ").alias("phrase"))
    return candidates.join(held, ["lang", "phrase", "a"], "left_anti")


def top_of_each_language(rows: DataFrame, params: PhraseParams) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= params.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= params.top)


def collocations(docs: DataFrame, params: PhraseParams | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line breaks (0x0A-0x0D), those into words at spaces and
    tabs. n counts all words of a language, f(phrase) all places of the phrase within pieces. Candidates have 2 to ``longest``
    words and a = f(phrase) >= min_count. A cut into a first part (l places) and a rest (r places) scores floor(scale * a * n / (l * r));
    the lowest-scoring one counts, the earliest among equals. Candidates within a longer one that is as frequent are left out. Order:
    score and a descending, phrase ascending (bytes of UTF-8).

    A null language is ``und``, as is one of that name. Null and empty texts have no words. Repeated rows count as often as they
    come. Other columns are ignored. No candidate: no rows.
    """
    params = params or PhraseParams()
    frequent = frequent_phrases(docs, params, text_col, lang_col)
    best = top_of_each_language(not_within_equals(scored(frequent, params), frequent), params)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(params: PhraseParams | None = None) -> str:
    """DuckDB SQL for the rows of ``collocations``."""
    p = params or PhraseParams()
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with texts as (select coalesce(lang, '{UNKNOWN}') as lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as text from documents),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from texts),
lists as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from lists group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from lists),
grams as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase from starts, range(1, {p.longest + 1}) as s(m) where i + m - 1 <= len(w)),
frequent as (select lang, m, phrase, count(*) as f from grams group by lang, m, phrase having count(*) >= {p.min_count}),
candidates as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from frequent where m >= 2),
cuts as (select lang, m, phrase, a, k, array_to_string(w[1 : k], ' ') as first, array_to_string(w[k + 1 : m], ' ') as rest
  from candidates, range(1, {p.longest}) as s(k) where k < m),
scores as (select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, t.n, (cast({p.scale} as hugeint) * c.a * t.n) // (cast(l.f as hugeint) * r.f) as score
  from cuts c join frequent l on l.lang = c.lang and l.phrase = first join frequent r on r.lang = c.lang and r.phrase = rest join totals t on t.lang = c.lang),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as nth from scores),
longer as (select distinct lang, array_to_string(w[i : i + s.n - 1], ' ') as phrase, a from candidates, range(2, {p.longest}) as s(n), range(1, {p.longest}) as o(i) where s.n < m and i + s.n - 1 <= m),
kept as (select * from lowest x where nth = 1 and not exists (select 1 from longer y where y.lang = x.lang and y.phrase = x.phrase and 100 * y.a >= 100 * x.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked where rank <= {p.top}
"""
