import sys
from collections import Counter

from pulsegrid.llm.storage import written


def test_stages(spark, sf):
    import corpus_pipeline as P

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_jaccard import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = written(P.language(spark, docs, sf), "t1")
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    single = written(P.near_duplicates(spark, kept, sf), "t2")
    want = {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in kept.collect()]) if d == c}
    assert {r["doc_id"] for r in single.collect()} == want
    clean = written(P.decontaminated(spark, single, sf), "t3")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()}
    assert gone == {r["doc_id"] for r in single.collect() if any(t in r["text"] for t in items)}
    mixed = written(P.mixed(spark, clean, sf), "t4")
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    out = P.tokens(spark, mixed, sf)
    assert out.count() == mixed.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [n for n, _ in P.STAGES] == ["language_id", "jaccard_dedup", "decontaminate", "mix", "token_blocks"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, rank long, label string"


def edge_rows():
    """Null and empty texts, null and repeated ids, copies, unlike languages, and columns named as the stages' own."""
    en = "the quick brown fox jumps over the lazy dog and runs away from it into the dark wood where nobody sees"
    es = "el rápido zorro marrón salta sobre el perro perezoso y huye de él hacia el bosque oscuro donde nadie"
    rows = [(i, f"{en} {i} {' '.join(en.split()[i % 9 :])} n{i}", "en", "a", 5, i, "x") for i in range(30)]
    rows += [(100 + i, f"{es} {i} {' '.join(es.split()[i % 9 :])} n{i}", "es", None, None, i, None) for i in range(30)]
    rows += [(None, f"{en} without an id", None, "b", 1, 0, "x"), (7, f"{es} again that id", "es", "b", 1, 0, "x"), (7, f"{es} again that id", "es", "b", 1, 0, "x")]
    return rows + [(200, None, "en", "a", 0, 0, "x"), (201, "", None, "a", 0, 0, "x"), (None, None, None, None, None, None, None), (202, "  \n\t", "es", "c", 3, 0, "x")]


def staged(spark, sf, rows):
    """Rows out of each stage, each given what the one before it kept."""
    import corpus_pipeline as P

    docs, out = spark.createDataFrame(rows, SCHEMA).repartition(2), []
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, sf), f"edge-{name}")
        out.append((docs.columns, [tuple(r) for r in docs.collect()]))
    return out


def test_edges_through_every_stage(spark, sf):
    import corpus_pipeline as P

    (c1, known), (c2, single), (c3, clean), (c4, mixed), (c5, tokens) = staged(spark, sf, edge_rows())
    assert c1 == c2 == c3 == c4 == list(P.COLUMNS) and c5 == ["doc_id", "start", "n_tokens", "ids_crc32"]
    texts = [r[1] for r in known]
    assert all(t and t.strip() for t in texts) and len(known) == 63  # no text without letters, every other row
    assert Counter(r[0] for r in known)[7] == 3 and None in {r[0] for r in known}
    assert set(single) <= set(known) and len({r[1] for r in single}) == len(single)
    assert set(clean) <= set(single) and set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 3
    assert len(tokens) == len(mixed) and Counter(r[0] for r in tokens) == Counter(r[0] for r in mixed)
    starts = sorted((r[1], r[2]) for r in tokens)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_empty_table_through_every_stage(spark, sf):
    assert [rows for _, rows in staged(spark, sf, [])] == [[]] * 5


def test_texts_without_letters_alone(spark, sf):
    """Nothing passes the first stage, and the others take the empty table that it leaves."""
    assert [len(rows) for _, rows in staged(spark, sf, [(1, None, "en", "a", 0, 0, "x"), (2, "12 34", None, None, 5, 0, "x")])] == [0] * 5
