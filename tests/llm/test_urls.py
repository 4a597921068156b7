import duckdb
import pytest

from argosift.llm import urls
from argosift.llm.queries import OP7_SQL
from argosift.llm.urls import RULES, judge_urls

URLS = ["http://a.net/", "http://net", "http://net/", "HTTPS://WWW.Example.NET/en/x?y#z", "https://example.net/de/", "http://example.com/de/page", "http://x.example.com/de", "http://b.org/fr/1", "http://xorg/fr/", "http://org/fr/", None, "", "no scheme", "://", "ftp://h/?q",
        "http://a.net?x=/en/", "http://example.net#/en/", "http://a.b.c.d.example.com/de/" + "p/" * 3000, "http://notexample.net/en/a", "http://a://net/", "http://.net/", "http://a..net/"]


def by_hand(url, rules=RULES):
    rest = url.partition("://")[2] if url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(r), r, v) for r, v in rules for h, _, p in [r.partition("/")] if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("most", [500_000, 0])
def test_edge_rows(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "_MOST_RULES", most)
    rows = [(i, u, "rule", "block") for i, u in enumerate(URLS)] + [(0, URLS[0], None, None), (None, URLS[3], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string")
    got = sorted((tuple(r) for r in judge_urls(pages).collect()), key=str)
    assert got == sorted(((i, *by_hand(u)) for i, u, *_ in rows), key=str)


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert judge_urls(pages, spark.createDataFrame([], "rule string, verdict string")).first().verdict == "allow"


def test_precedence(spark):
    rules = [("com/", "block"), ("a.com/", "allow"), ("a.com/x", "block"), ("b.a.com/", "allow"), ("b.a.com/", "block")]
    pages = spark.createDataFrame([(1, "h://c.com/"), (2, "h://a.com/y"), (3, "h://a.com/xy"), (4, "h://b.a.com/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block", 4: "block"}


@pytest.mark.parametrize("most", [500_000, 0])
def test_hosts_alone_and_capitals(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "_MOST_RULES", most)
    rules = [("net", "block"), ("Example.ORG/en/", "block"), ("/", "block"), (None, "block")]
    pages = spark.createDataFrame([(1, "h://a.net"), (2, "h://net/x"), (3, "h://w.example.org/en/1"), (4, "h://w.example.org/EN/1"), (5, "h://xnet/"), (6, "h://dot./")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages.unionAll(pages), rules).collect()}
    assert got == {1: ("net", "block"), 2: ("net", "block"), 3: ("Example.ORG/en/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: ("/", "block")}


def test_whole_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP7_SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in judge_urls(spark.read.parquet(f"{sf}/pages.parquet")).collect()), key=str) == want
