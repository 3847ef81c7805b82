import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import language as L


def test_codewords_differ():
    for n in (2, 3, 4, 7, 12, 40):
        code = L.codewords(n).astype(int)
        assert len({tuple(r) for r in code.tolist()}) == n
        distance = (code.shape[1] - code @ code.T) // 2
        least = distance[~np.eye(n, dtype=bool)].min()
        assert least >= {2: 1, 3: 2, 4: 4, 7: 32}.get(n, 10)


def test_features_do_not_depend_on_pieces(monkeypatch):
    """Counted run by run or at once: the same grams, as many as there are."""
    text = np.frombuffer(("Ein Satz,  zwei Sätze. 12 " * 700).encode(), np.uint8)
    whole = L.features(text, 1 << 10)
    assert whole.shape == (1 << 10,) and np.isclose((whole**2).sum(), 1, atol=1e-4)
    seen = L._collapsed(text)
    for run in (100, 999, len(seen)):
        monkeypatch.setattr(L, "GRAM_RUN", run)
        assert np.array_equal(L.features(text, 1 << 10), whole)
        assert sum(len(g) for n in range(1, 5) for g in L._grams(seen, n, 1 << 10)) == 4 * len(seen) - 6


def test_model_travels_whole():
    rng = np.random.default_rng(1)
    x, y = rng.random((40, 16)).astype(np.float32), np.arange(40) % 3
    p = L.LanguageParams(features=16, epochs=5)
    model = L.fit(x, y, ["a", "b", "c"], p)
    again = L.LanguageModel.from_bytes(model.to_bytes(), ["a", "b", "c"], p)
    m = x @ model.weights + model.bias
    assert all(np.array_equal(u, v) for u, v in zip(model.decode(m), again.decode(m)))
    tie = model.decode(np.zeros((1, model.code.shape[1])))
    assert 0 <= tie[1][0] <= 1 and tie[2][0]


def test_many_labels_are_all_learned(spark):
    rows = [(i, f"word{i % 70} " * 5, f"l{i % 70:02d}") for i in range(280)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), L.LanguageParams(features=256, epochs=3))
    assert len(model.languages) == 70


@pytest.fixture(scope="module")
def result(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held_out", L.held_out())
    return L.train(docs.where("not held_out")), docs


def test_held_out_accuracy(result):
    model, docs = result
    out = L.identify(docs.where("held_out"), model, keep=("doc_id", "lang")).toPandas()
    assert len(out) and (out["lang"] == out["lang_pred"]).mean() > 0.95
    assert out["score"].between(0, 1).all() and not out["ambiguous"].all()


def test_edges(spark, result):
    model, docs = result
    rows = [(1, None), (2, ""), (3, " 123 !? "), (4, "É"), (5, "the and of " * 100_000), (5, "the and of"), (None, "le la et")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(1))
    out = {(r["doc_id"], r["lang_pred"]) for r in L.identify(df, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= out and (4, "und") not in out and len([d for d, _ in out]) >= 6
    empty = L.identify(df.limit(0), model)
    assert empty.count() == 0
    untrained = L.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in L.identify(df, untrained).collect()} == {"und"}


def made_texts(n=300):
    en = "the quick brown fox jumps over the lazy dog and runs away from it"
    es = "el rápido zorro marrón salta sobre el perro perezoso y huye de él"
    return [(f"{en} {i} {en[i % 9:]}", "en") for i in range(n)] + [(f"{es} {i} {es[i % 9:]}", "es") for i in range(n)]


def test_null_and_repeated_ids(spark):
    """Whatever the ids are, every labelled language is learned: all null, null for one language, all equal, all rows equal."""
    texts = made_texts()
    for id_of in (lambda i, lang: None, lambda i, lang: None if lang == "en" else i, lambda i, lang: 5, lambda i, lang: i):
        df = spark.createDataFrame([(id_of(i, lang), t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
        model = L.train(df, L.LanguageParams(docs_per_language=40, epochs=60))
        out = L.identify(df, model, keep=("lang",)).toPandas()
        assert model.languages == ["en", "es"] and (out.lang == out.lang_pred).mean() > 0.99
    copies = spark.createDataFrame([(None, texts[0][0], "en")] * 500 + [(None, texts[-1][0], "es")] * 3, "doc_id long, text string, lang string")
    model = L.train(copies, L.LanguageParams(docs_per_language=5, epochs=60))
    out = L.identify(copies, model, keep=("lang",)).toPandas()
    assert (out.lang == out.lang_pred).all()


def test_decoder_against_plain_python(result):
    """Nearest codeword by weighted logistic losses, its softmax chance and near ties, computed word by word."""
    import math

    model = result[0]
    rng = np.random.default_rng(0)
    margins = rng.normal(size=(200, model.code.shape[1])).astype(np.float32) * 3  # as texts' margins are
    first, score, near = model.decode(margins)
    for k, m in enumerate(margins):
        weights = model.bit_weights.tolist()
        loss = [sum(w * math.log1p(math.exp(-c * v)) for w, c, v in zip(weights, word, m.tolist())) / sum(weights) for word in model.code.tolist()]
        raw = [math.exp(-model.sharpness * len(m) * (x - min(loss))) for x in loss]
        chance = sorted((r / sum(raw) for r in raw), reverse=True)
        assert first[k] == loss.index(min(loss)) and score[k] == pytest.approx(chance[0], rel=1e-4)
        odds = chance[0] / chance[1] / model.params.odds
        assert near[k] == (odds < 1) or abs(odds - 1) < 1e-4


def test_features_against_plain_counts():
    """Roots of the counts of hashed grams: as many grams as there are windows of each length, case and gaps folded."""
    text = "Ab, c--D é"
    codes = [0, 1, 2, 0, 3, 0, 4, 0, 26 + 195 - 127, 26 + 169 - 127, 0]
    got = L.features(np.frombuffer(text.encode(), np.uint8), 1 << 13)
    want = np.zeros(1 << 13)
    for n in range(1, 5):
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i : i + n]:
                h = (h * 155 + c) % 2**32
            h = (h * 2654435761 + n * 0x9E3779B9) % 2**32 * 0x85EBCA6B % 2**32
            want[h >> (32 - 13)] += 1
    want = np.sqrt(want)
    assert np.allclose(got, want / np.sqrt((want**2).sum()), atol=1e-6)
