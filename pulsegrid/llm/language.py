"""Language identification by error-correcting output codes.

Every language has a codeword; one linear classifier over hashed byte n-grams predicts each bit, and
the language whose codeword has the smallest loss-weighted distance to the predicted margins wins.
Two codewords at nearly the same distance flag the text as ambiguous.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekernel as bk

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")

# Bytes that n-grams see: lower-cased ASCII letters and bytes of other characters; all else is one gap.
_SEEN = np.zeros(256, np.uint8)
_SEEN[97:123] = np.arange(1, 27)
_SEEN[65:91] = np.arange(1, 27)
_SEEN[128:] = np.arange(27, 155)


#: Places that a hash gives rows to choose a sample by.
SPREAD = 1 << 30
#: Grams whose hashes are held at once; longer texts are counted run by run, with the same result.
GRAM_RUN = 1 << 20


@dataclass(frozen=True)
class LanguageParams:
    """``docs_per_language`` and ``examples`` bound the labelled sample that is fitted: at most ``examples`` texts in all
    (one a language at least), whose ``features`` float32 numbers meet in one task. Every language is learned."""

    features: int = 1 << 13
    docs_per_language: int = 400
    examples: int = 4096
    epochs: int = 300
    learning_rate: float = 0.5
    l2: float = 1e-5
    odds: float = 1.25
    seed: int = 7

    def __post_init__(self):
        if self.features & (self.features - 1) or self.docs_per_language < 1 or self.examples < 1 or self.odds < 1:
            raise ValueError("features must be a power of two, docs_per_language and examples positive, odds at least 1")


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of -1/+1: all distinct bipartitions up to 7 classes, else the random code of
    ceil(15 log2 n) bits with the largest least distance among 200 drawn."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        return np.array([[1 if (b >> (n - 1 - c)) & 1 else -1 for b in range(1 << (n - 1), (1 << n) - 1)] for c in range(n)], np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(15 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        distance = (bits - code.astype(int) @ code.T.astype(int)) // 2
        least = int(distance[~np.eye(n, dtype=bool)].min())
        if least > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, least
    return best


def _collapsed(data: np.ndarray) -> np.ndarray:
    """Codes of the seen bytes of one text, each gap as one 0, and a gap before and after."""
    seen = _SEEN[data]
    seen = seen[(seen != 0) | np.concatenate(([True], seen[:-1] != 0))]
    return np.concatenate((np.zeros(1, np.uint8), seen, np.zeros(1, np.uint8)))


def _grams(seen: np.ndarray, n: int, size: int) -> Iterator[np.ndarray]:
    """Hashed n-grams of a collapsed text, in runs of at most GRAM_RUN."""
    shift, salt = np.uint32(32 - (size.bit_length() - 1)), np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)
    for a in range(0, len(seen) - n + 1, GRAM_RUN):
        part = seen[a : a + GRAM_RUN + n - 1].astype(np.uint32)
        code = part[: len(part) - n + 1]
        for k in range(1, n):
            code = code * np.uint32(155) + part[k : len(part) - n + 1 + k]
        yield (code * np.uint32(2654435761) + salt) * np.uint32(0x85EBCA6B) >> shift


def features(data: np.ndarray, size: int) -> np.ndarray:
    """Square roots of the counts of all 1-, 2-, 3- and 4-grams of one text, scaled to length 1."""
    seen = _collapsed(data)
    counts = np.zeros(size, np.int64)
    if len(seen) <= GRAM_RUN:
        counts += np.bincount(np.concatenate([g for n in range(1, 5) for g in _grams(seen, n, size)]), minlength=size)
    else:
        for n in range(1, 5):
            for g in _grams(seen, n, size):
                counts += np.bincount(g, minlength=size)
    root = np.sqrt(counts).astype(np.float32)
    return root / max(float(np.sqrt((root * root).sum())), 1e-9)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray
    sharpness: float
    params: LanguageParams

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """(texts, languages): mean logistic loss of each codeword's bits, weighted by the bits' accuracy in training."""
        return (np.logaddexp(0, -self.code[None] * margins[:, None]) * self.bit_weights).sum(2) / self.bit_weights.sum()

    def chances(self, margins: np.ndarray, sharpness: float | None = None) -> np.ndarray:
        """(texts, languages): softmax of -sharpness * bits * loss; the sharpness is calibrated on rows held back from the fit."""
        loss = self.losses(margins)
        chance = np.exp(-(sharpness or self.sharpness) * self.code.shape[1] * (loss - loss.min(1, keepdims=True)))
        return chance / chance.sum(1, keepdims=True)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword (equally near ones: the first by name), its chance, and whether its odds
        against the runner-up are below ``odds``, which makes the answer ambiguous."""
        chance = self.chances(margins)
        order = np.argsort(-chance, axis=1, kind="stable")
        rows = np.arange(len(chance))
        first, score = order[:, 0], chance[rows, order[:, 0]]
        near = score < self.params.odds * chance[rows, order[:, 1]] if chance.shape[1] > 1 else np.zeros(len(chance), bool)
        return first, score, near

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, code=self.code, weights=self.weights, bias=self.bias, bit_weights=self.bit_weights, sharpness=self.sharpness)
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes, languages: list[str], params: LanguageParams) -> LanguageModel:
        with np.load(io.BytesIO(raw)) as found:
            return LanguageModel(languages, found["code"], found["weights"], found["bias"], found["bit_weights"], float(found["sharpness"]), params)


def fit(x: np.ndarray, labels: np.ndarray, languages: list[str], params: LanguageParams) -> LanguageModel:
    """Full-batch logistic regression of every bit with momentum; same rows, same model.

    Every fourth row of a language is held back (where it has four) to calibrate the sharpness of the scores.
    """
    order = np.argsort(labels, kind="stable")
    nth = np.empty(len(labels), np.int64)
    nth[order] = np.arange(len(labels)) - np.searchsorted(labels[order], labels[order])
    held = nth % 4 == 3
    code = codewords(len(languages), params.seed)
    xf, yf = (x[~held], labels[~held]) if held.any() else (x, labels)
    target = code[yf].astype(np.float32)
    # every language weighs the same
    share = (1 / np.maximum(np.bincount(yf, minlength=len(languages)), 1))[yf].astype(np.float32)
    share /= share.sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(params.epochs):
        margin = xf @ w + b
        pull = share[:, None] * target / (1 + np.exp(np.clip(target * margin, -30, 30)))
        vw = 0.9 * vw + params.learning_rate * (len(languages) * (xf.T @ pull) - params.l2 * w)
        vb = 0.9 * vb + params.learning_rate * pull.sum(0)
        w, b = w + vw, b + vb
    right = (share[:, None] * (target * (xf @ w + b) > 0)).sum(0)
    model = LanguageModel(languages, code.astype(np.float32), w, b, np.clip(right, 0.5, 1) ** 2, 1.0, params)
    if held.any():
        margins, rows = x[held] @ w + b, np.arange(int(held.sum()))
        likely = [(float(np.log(np.maximum(model.chances(margins, s)[rows, labels[held]], 1e-12)).mean()), s) for s in (0.0625, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)]
        model.sharpness = max(likely)[1]
    return model


def train(docs: DataFrame, params: LanguageParams | None = None, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fit on the ``docs_per_language`` rows of each language (fewer if ``examples`` forces it) whose id and text have the smallest
    hashes; equal rows count as one. Ids may be null or repeated. Null texts and null or empty labels are left out; a text without
    letters counts as one gap.

    The sample's features meet in one task, which fits and returns the weights alone; the driver holds no row.
    No labelled row at all gives a model without languages, which answers ``und``.
    """
    params = params or LanguageParams()
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("label is not null and label != '' and text is not null")
    # Rows are chosen by a hash of id and text, so those without an id or of one id are told apart.
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit(params.seed)), F.lit(SPREAD))
    placed = named.withColumn("place", place)
    found = placed.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.min("place").alias("least")).orderBy("label").collect()  # one row a language
    languages = [r["label"] for r in found]
    if not found:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((params.features, 1)), np.zeros(1), np.ones(1), 1.0, params)
    each = max(1, min(params.docs_per_language, params.examples // len(languages)))
    # A bound per language keeps about twice the rows wanted, so that few rows are ranked; the row of least place always stays.
    bound = F.create_map(*[F.lit(v) for r in found for v in (r["label"], max(r["least"] + 1, min(SPREAD, -(-SPREAD * 2 * (each + 20) // r["count"]))))])
    # Equal rows are one before they are ranked, however many there are.
    chosen = placed.where(F.col("place") < bound[F.col("label")]).select("label", "place", "id", "text").distinct()
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("place", "id", "text"))).where(F.col("rank") <= each)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bk.buffers(batch.column(2))
            rows = [features(data[a:b], params.features).astype("<f4").tobytes() for a, b in zip(off[:-1], off[1:])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["label", "rank", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, x = [], []
        for batch in batches:
            labels += [languages.index(v) for v in batch.column(0).to_pylist()]
            x += [np.frombuffer(v.as_py(), "<f4") for v in batch.column(2)]
        if x:
            model = fit(np.stack(x), np.array(labels, np.int64), languages, params)
            yield pa.record_batch([pa.array([model.to_bytes()], pa.binary())], names=["model"])

    sample = ranked.select("label", "rank", "text").mapInArrow(extract, "label string, rank int, x binary")
    one = sample.repartition(1).sortWithinPartitions("label", "rank")  # at most ``examples`` rows
    return LanguageModel.from_bytes(one.mapInArrow(fitted, "model binary").first()["model"], languages, params)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score and ambiguous of every row, from the whole text alone.

    Null texts and texts without letters are ``und`` with score 0; so is everything if the model has
    no languages. Repeated rows give equal rows. The model (features x bits numbers) travels with the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by features x bits
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = m.params.features
        names = np.array([*m.languages, UNDETERMINED], object)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(batch.num_columns - 1)
                data, off = bk.buffers(texts)
                n = len(off) - 1
                lang, score, near = np.full(n, len(m.languages)), np.zeros(n), np.zeros(n, bool)
                letters = [i for i, t in enumerate(texts) if m.languages and t.is_valid and _LETTER.search(t.as_py())]
                if letters:
                    x = np.stack([features(data[off[i] : off[i + 1]], size) for i in letters])
                    lang[letters], score[letters], near[letters] = m.decode(x @ m.weights + m.bias)
                yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array(names[lang], pa.string()), pa.array(score), pa.array(near)], names=[*keep, "lang_pred", "score", "ambiguous"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
