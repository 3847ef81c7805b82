import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import reputation as R
from pulsegrid.llm.queries import QUERIES


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(map(str, con.sql(f"select page_id, host, path, rule, verdict from ({R.oracle_sql()})").fetchall()))
    got = sorted(str(tuple(r)) for r in QUERIES["op9_url_reputation"](spark, sf).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == want


URLS = [
    ("http://A.example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
    ("https://x.com/en/", "x.com", "/en/", "com/en/", "block"),
    ("https://com/en/5", "com", "/en/5", "com/en/", "block"),
    ("https://telecom/en/5", "telecom", "/en/5", None, None),
    ("ftp://n.example.net/de/8#a", "n.example.net", "/de/8", "example.net/de/8", "block"),
    ("ftp://n.example.net/de/9", "n.example.net", "/de/9", "net/de/", "allow"),
    ("//no.scheme/en/", "", "", None, None),
    ("http://", "", "", None, None),
    ("http://h.org?x=/es/", "h.org", "", None, None),
    ("http://h.org/es/a://b/c", "h.org", "/es/a://b/c", "org/es/", "block"),
    (None, "", "", None, None),
    ("", "", "", None, None),
]


def test_rules_and_edges(spark):
    df = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "x", "y")], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "host string, bad long")
    out = R.judge(df, none).collect()
    assert len(out) == len(URLS) + 1
    by = {r["page_id"]: r for r in out}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = by[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert R.judge(df.limit(0), none).count() == 0


def test_rules_are_those_of_the_contract(spark):
    """Each rule's word on its own, and the SQL's verdicts of the same pages."""
    rules = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    assert {(h, p): v for v, h, p in R.RULES} == rules
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(rules)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in R.judge(df, spark.createDataFrame([("net", 1)] * 50, "host string, bad long")).collect()}
    assert got == dict(enumerate(rules.values()))
    con = duckdb.connect()
    con.sql("create table pages as select * from (values " + ", ".join(f"({i}::bigint, 'http://{h}{p}')" for i, (h, p) in enumerate(rules)) + ") t(page_id, url)")
    con.sql("create table labels (doc_id bigint, quality int, toxic int)")
    assert {r[0]: r[4] for r in con.sql(R.oracle_sql()).fetchall()} == got


def test_shrinking(spark):
    rows = [("bad.a.com", 1)] * 40 + [("good.a.com", 0)] * 40 + [("once.b.com", 1)] + [(f"h{i}.c.com", 0) for i in range(30)] + [(None, 1), ("bad.a.com", None)]
    outcomes = spark.createDataFrame(rows, "host string, bad long")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["bad.a.com", "good.a.com", "once.b.com", "new.a.com", "h1.c.com"])], "page_id long, url string")
    out = {r["host"]: (r["verdict"], r["bad_rate"]) for r in R.judge(pages, outcomes).collect()}
    assert out["bad.a.com"][0] == "block" and out["good.a.com"][0] == "allow" and out["once.b.com"][0] == "allow"
    assert out["good.a.com"][1] < out["new.a.com"][1] < out["bad.a.com"][1] and out["once.b.com"][1] < 1
    with pytest.raises(ValueError):
        R.ReputationParams(max_bad_rate=1.5)
    assert F is not None


def test_outcomes_of_every_url_form(spark):
    """A document's number may end a path, stand before a slash, or before a file ending; counts by hand."""
    urls = ["http://a.com/en/7", "http://a.com/en/7/", "http://a.com/en/7.html", "http://a.com/en/7.html?x=1", "http://a.com/en/8#top", "http://a.com/en/8x", "http://a.com/8/en", "http://a.com/en/9.html", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0), (9, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in R.page_outcomes(pages, labels).collect())
    assert got == [("a.com", 0)] + [("a.com", 1)] * 4


def test_sites(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.com:8080", "u@y.x.com", "10.0.0.1:80", "[::1]:80", "localhost", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *R.site(F.col("host")))
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert got == {
        "a.b.co.uk": ("a.b.co.uk", "b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk", "co.uk"), "x.com:8080": ("x.com", "x.com", "com"), "u@y.x.com": ("y.x.com", "x.com", "com"),
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", ""), "[::1]:80": ("[::1]", "[::1]", ""), "localhost": ("localhost", "localhost", "localhost"), "": ("", "", ""),
    }


def test_sql_on_odd_hosts(spark, tmp_path):
    rows = [(i, u[0]) for i, u in enumerate(URLS)] + [(100 + i, f"http://{h}/en/{i}{e}") for i, (h, e) in enumerate([("a.co.uk", ""), ("b.co.uk:80", "/"), ("10.1.2.3", ".html"), ("u@c.org", ""), ("c.org", ".txt"), ("[::1]:9", "")] * 5)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(map(str, con.sql(f"select page_id, host, path, rule, verdict from ({R.oracle_sql()})").fetchall()))
    got = sorted(str(tuple(r)) for r in QUERIES["op9_url_reputation"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == want and {r[-1] for r in con.sql(R.oracle_sql()).fetchall()} == {"allow", "block"}
