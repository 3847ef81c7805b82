"""Secret scanning: fixed patterns, and a character convolutional network over candidates in context.

Base findings come from three patterns. The network scores every candidate (the values of base findings,
and other tokens that may be keys) whole and in its surrounding text, and adds what passes its threshold; base
findings stay. It learns from labelled findings: generated ones, and a bounded sample of the corpus's own,
which the patterns label; its threshold is the largest that keeps the wanted recall on rows held back.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "cnn")

#: Candidates besides the base findings: tokens of key alphabets with a digit and a letter, and long ones of any kind.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
LONG_CANDIDATE = 24
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Characters of context before and after a candidate, and of a candidate that one piece of the convolution sees.
BEFORE, AFTER, PIECE = 32, 16, 4096


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind in the order of KINDS."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def value_span(text: str, span: tuple[str, int, int]) -> tuple[int, int]:
    """The part of a base finding that is the secret itself."""
    kind, a, b = span
    return ASSIGN.match(text, a).span(2) if kind == "assign" else (a, b)


def other_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans of possible keys that overlap no base finding."""
    starts = [a for _, a, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_left(starts, b)
        if k and reach[k - 1] > a:
            continue
        if b - a >= LONG_CANDIDATE or _DIGIT.search(text, a, b) and _LETTER.search(text, a, b):
            out.append((a, b))
    return out


def _codes() -> np.ndarray:
    """Character classes: lower-case hex and other letters, upper-case ones, digits, and punctuation each for itself."""
    codes = np.full(128, 1, np.int8)
    for n, group in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\n", "=", ":", "\"'", "-", "_", "/", "+", ".", "@#$%&*")):
        for c in group:
            codes[ord(c)] = n + 2
    return codes


_CODES = _codes()
N_CODES = 18


def _classes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 128, _CODES[np.minimum(raw, 127)], N_CODES - 1).astype(np.int8)


@dataclass(frozen=True)
class Example:
    """Character classes of a whole candidate and of the context before and after it; 0 pads the context."""

    before: np.ndarray
    inside: np.ndarray
    after: np.ndarray


def encode(text: str, start: int, end: int) -> Example:
    before, after = np.zeros(BEFORE, np.int8), np.zeros(AFTER, np.int8)
    left, right = _classes(text[max(0, start - BEFORE) : start]), _classes(text[end : end + AFTER])
    before[BEFORE - len(left) :], after[: len(right)] = left, right
    return Example(before, _classes(text[start:end]), after)


@dataclass(frozen=True)
class NetParams:
    """``examples`` bounds the generated findings and ``corpus_examples`` those of the corpus that are fitted (a quarter
    of both is held back for calibration); ``fit_chars`` is the longest candidate that is fitted."""

    examples: int = 2400
    corpus_examples: int = 800
    fit_chars: int = 128
    filters: int = 24
    kernel: int = 5
    epochs: int = 10
    batch: int = 64
    learning_rate: float = 0.1
    recall: float = 0.95
    seed: int = 11


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is a secret): keys of several alphabets and harmless tokens, both with and without keywords."""
    rng = np.random.default_rng(seed)
    hexes, base64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    alnum, lower = base64[:62], base64[26:62]
    syllables = "an en er in re on th he te or st ar nd to nt ed is ha ou ea ti es it io le".split()
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    word = lambda k: "".join(syllables[i] for i in rng.integers(0, len(syllables), k))
    number = lambda k: int(rng.integers(0, k))
    keys = ("token", "secret", "password", "passwd", "api_key", "apikey", "Token", "SECRET", "auth", "key")
    out = []
    while len(out) < n:
        secret, kind, size = len(out) % 2, number(7), 12 + number(52)
        if secret:
            token = [draw(hexes, size), draw(hexes.upper(), size), draw(base64, size), draw(alnum, size), draw(lower, size), f"sk-{draw(alnum, size)}", f"AKIA{draw(alnum[:26] + alnum[52:], 16)}"][kind]
        else:
            token = [f"{word(4)}-{number(3000)}-{word(3)}", f"{word(6)}{number(100)}", f"{word(3)}_{word(4)}_v{number(9)}", f"2{number(1000):03d}-{1 + number(12):02d}-{1 + number(28):02d}T{number(24):02d}-00-00Z", f"/{word(3)}/{word(4)}/{number(100000)}", word(13), f"{word(2)}{number(10)}{word(2)}"][kind]
        if len(token) < 8:
            continue
        quote = ("", '"', "'")[number(3)]
        before = [f"{word(2)} {word(3)} ", f"{word(2)} {keys[number(len(keys))]} = {quote}", f"{keys[number(len(keys))]}: {quote}", f"{word(2)}. {word(2).title()} ", f'"{word(3)}": {quote}', "\n"][number(6) if secret else (0, 3, 4, 5, 0, 1)[number(6)]]
        after = [quote + " " + word(3), quote + "\n", quote + ".", quote + ", "][number(4)]
        out.append((before + token + after, len(before), len(before) + len(token), secret))
    return out


def corpus_findings(docs: DataFrame, params: NetParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int, int]]:
    """(text, start, end, is a secret) of a bounded sample of candidates of ``docs`` with their contexts: values of base
    findings as secrets, other candidates as harmless, ``corpus_examples`` at most of both, by a hash of their texts."""
    params = params or NetParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                text, rows = text.as_py(), []
                base = base_spans(text)
                spans = [(*value_span(text, s), 1) for s in base] + [(*s, 0) for s in other_candidates(text, base)]
                for a, b, label in spans:
                    if b - a <= params.fit_chars:
                        left = max(0, a - BEFORE)
                        rows.append((text[left : b + AFTER], a - left, b - left, label))
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["text", "start", "end", "label"])

    # Python sees only texts in which a base pattern may be found.
    likely = F.col(text_col).rlike(r"(?i)passw|secret|token|api_?key") | F.col(text_col).rlike(r"AKIA|[0-9a-f]{24}")
    found = docs.where(likely).select(F.col(text_col).alias("_text")).mapInArrow(run, "text string, start int, end int, label int").distinct()
    half = params.corpus_examples // 2
    place = F.xxhash64("text", "start", F.lit(params.seed))
    rows = [r for label in (1, 0) for r in found.where(F.col("label") == label).orderBy(place, "text", "start", "end").limit(half).collect()]
    return [(r["text"], r["start"], r["end"], r["label"]) for r in rows]


class CharNet:
    """Convolution over one-hot classes, ReLU, maxima over both contexts, maximum and mean over the whole candidate, logistic output."""

    def __init__(self, params: NetParams):
        rng = np.random.default_rng(params.seed)
        self.params, f = params, params.filters
        self.conv = rng.normal(0, 0.3, (params.kernel, N_CODES, f)).astype(np.float32)
        self.conv_bias = np.zeros(f, np.float32)
        self.out = rng.normal(0, 0.2, 4 * f).astype(np.float32)
        self.out_bias = np.float32(0)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _layout(self, examples: list[Example], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of context, candidate padded to ``width``, gap, context and gap, and the candidates' sizes. The gaps are as
        wide as the kernel reaches, so that a row's result doesn't depend on ``width``."""
        gap = self.params.kernel - 1
        x = np.zeros((len(examples), BEFORE + width + gap + AFTER + gap), np.int8)
        for row, e in zip(x, examples):
            row[:BEFORE], row[BEFORE : BEFORE + len(e.inside)], row[BEFORE + width + gap : -gap or None] = e.before, e.inside, e.after
        return x, np.array([len(e.inside) for e in examples])

    def _convolved(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - self.params.kernel + 1
        return np.maximum(self.conv_bias + sum(self.conv[j][x[:, j : j + n]] for j in range(self.params.kernel)), 0)

    def _parts(self, h: np.ndarray, sizes: np.ndarray, width: int):
        inside = h[:, BEFORE : BEFORE + width]
        seen = np.arange(width)[None, :, None] < sizes[:, None, None]
        return h[:, :BEFORE], np.where(seen, inside, 0), h[:, BEFORE + width + self.params.kernel - 1 :], seen

    def _pooled(self, examples: list[Example], width: int) -> np.ndarray:
        x, sizes = self._layout(examples, width)
        before, inside, after, _ = self._parts(self._convolved(x), sizes, width)
        return np.concatenate((before.max(1), inside.max(1), inside.sum(1) / sizes[:, None], after.max(1)), 1)

    def _pooled_long(self, e: Example) -> np.ndarray:
        """The same for one candidate of any length, piece by piece."""
        f, n, reach = self.params.filters, len(e.inside), self.params.kernel - 1
        out = self._pooled([Example(e.before, e.inside[:PIECE], e.after)], PIECE)[0]
        joined = np.concatenate((e.before, e.inside, np.zeros(reach, np.int8)))
        out[:f] = self._convolved(joined[None, : BEFORE + reach])[0, :BEFORE].max(0)
        top, total = np.zeros(f, np.float32), np.zeros(f, np.float64)
        for a in range(0, n, PIECE):
            h = self._convolved(joined[None, BEFORE + a : BEFORE + min(a + PIECE, n) + reach])[0]
            top, total = np.maximum(top, h.max(0)), total + h.sum(0)
        out[f : 2 * f], out[2 * f : 3 * f] = top, total / n
        return out

    def logits(self, examples: list[Example]) -> np.ndarray:
        """Outputs in the order of ``examples``, which are taken together by length."""
        pooled = np.zeros((len(examples), 4 * self.params.filters), np.float32)
        by: dict[int, list[int]] = {}
        for i, e in enumerate(examples):
            by.setdefault(max(32, 1 << (max(1, len(e.inside)) - 1).bit_length()), []).append(i)
        for width, rows in by.items():
            if width > PIECE:
                for i in rows:
                    pooled[i] = self._pooled_long(examples[i])
                continue
            step = max(1, (1 << 16) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                pooled[part] = self._pooled([examples[i] for i in part], width)
        return pooled @ self.out + self.out_bias

    def fit(self, examples: list[Example], y: np.ndarray) -> None:
        p, rng, width = self.params, np.random.default_rng(self.params.seed), self.params.fit_chars
        f, x_all, sizes_all = p.filters, *self._layout(examples, width)
        n_pos = x_all.shape[1] - p.kernel + 1
        weight = np.where(y == 1, 0.5 / max(1, int((y == 1).sum())), 0.5 / max(1, int((y == 0).sum()))) * len(y)
        state = [np.zeros_like(self.conv), np.zeros_like(self.conv_bias), np.zeros_like(self.out), np.float32(0)]
        eye = np.eye(N_CODES, dtype=np.float32)
        for _ in range(p.epochs):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // p.batch)):
                x, sizes, rows = x_all[at], sizes_all[at], np.arange(len(at))
                h = self._convolved(x)
                before, inside, after, seen = self._parts(h, sizes, width)
                tops = [part.argmax(1) for part in (before, inside, after)]
                pooled = np.concatenate((before.max(1), inside.max(1), inside.sum(1) / sizes[:, None], after.max(1)), 1)
                z = pooled @ self.out + self.out_bias
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at] / len(at)).astype(np.float32)
                dp = d[:, None] * self.out
                dh = np.zeros_like(h)
                dh[:, BEFORE : BEFORE + width] += seen * (dp[:, None, 2 * f : 3 * f] / sizes[:, None, None])
                for k in range(f):
                    dh[rows, tops[0][:, k], k] += dp[:, k]
                    dh[rows, BEFORE + tops[1][:, k], k] += dp[:, f + k]
                    dh[rows, BEFORE + width + p.kernel - 1 + tops[2][:, k], k] += dp[:, 3 * f + k]
                dh *= h > 0
                g_conv = np.stack([np.tensordot(eye[x[:, j : j + n_pos]], dh, ((0, 1), (0, 1))) for j in range(p.kernel)])
                for k, (g, name) in enumerate(((g_conv, "conv"), (dh.sum((0, 1)), "conv_bias"), (pooled.T @ d, "out"), (d.sum(), "out_bias"))):
                    state[k] = (0.9 * state[k] - p.learning_rate * g).astype(np.float32)
                    setattr(self, name, getattr(self, name) + state[k])

    def calibrate(self, examples: list[Example], y: np.ndarray) -> None:
        """Platt scaling on held-back findings; the threshold is the largest that keeps the wanted recall on them."""
        z = self.logits(examples).astype(np.float64)
        a, b = 1.0, 0.0
        for _ in range(500):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.05 * float(((q - y) * z).mean()), b - 0.05 * float((q - y).mean())
        self.scale, self.shift = a, b
        hits = np.sort(self.score(examples)[y == 1])
        if len(hits):
            self.threshold = float(hits[int((1 - self.params.recall) * len(hits))])

    def score(self, examples: list[Example]) -> np.ndarray:
        z = self.logits(examples).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def train(params: NetParams | None = None, findings: list[tuple[str, int, int, int]] | None = None) -> CharNet:
    """Fit and calibrate on generated findings and, if given, the corpus's; candidates over ``fit_chars`` are left out."""
    params = params or NetParams()
    made = labelled_findings(params.examples, params.seed)
    rows = [r for part in (made, findings or []) for r in part if r[2] - r[1] <= params.fit_chars]
    examples, y = [encode(t, a, b) for t, a, b, _ in rows], np.array([v for *_, v in rows], np.float32)
    held = np.arange(len(y)) // 2 % 4 == 3  # by pairs, as generated secrets and others take turns
    net = CharNet(params)
    net.fit([e for e, h in zip(examples, held) if not h], y[~held])
    net.calibrate([e for e, h in zip(examples, held) if h], y[held])
    return net


def find(texts: list[str | None], net: CharNet) -> list[tuple[list, list[float]]]:
    """For every text its spans (kind, start, end) by start, then kind, and the network's score of each."""
    rows, x = [], []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        others = other_candidates(text, base)
        rows.append(base + [("cnn", a, b) for a, b in others])
        x += [encode(text, *span) for span in (*(value_span(text, s) for s in base), *others)]
    scores = net.score(x) if x else np.zeros(0)
    out, at = [], 0
    for spans in rows:
        s = scores[at : at + len(spans)].tolist()
        at += len(spans)
        kept = sorted(((span, v) for span, v in zip(spans, s) if span[0] != "cnn" or v >= net.threshold), key=lambda p: (p[0][1], KINDS.index(p[0][0]), p[0][2]))
        out.append(([p[0] for p in kept], [p[1] for p in kept]))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, net: CharNet | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kinds, starts, ends and scores (arrays, one entry a finding) of every row.

    Without ``net`` one is trained, on a bounded sample of the findings of ``docs`` itself too. Null texts count as
    empty and give empty arrays; repeated rows give equal results; other columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or train(findings=corpus_findings(docs, None, id_col, text_col)))  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = find(part.column(1).to_pylist(), shared.value)
                columns = [[[s[k] for s in spans] for spans, _ in found] for k in range(3)] + [[v for _, v in found]]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
                yield pa.record_batch([part.column(0), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, kinds))], names=["doc_id", "kinds", "starts", "ends", "scores"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, kinds array<string>, starts array<long>, ends array<long>, scores array<double>")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans as text."""
    span = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")))
    base = F.filter(span, lambda s: ~s.startswith("cnn:"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(span, ",").alias("spans"), count("cnn").alias("n_cnn"))
