"""URL filter: rules against Python, the models against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.queries import ORACLES, op9_url_filter
from tallyloom.llm.urls import RULES, judge_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(LOWER), tail[:end]


def rule_of(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "https://Example.com/en/Page?q=1#x", "http://www.example.com/en/", "http://a.www.example.com/en/x", "http://example.com/de/", "http://badexample.com/en/",
    "https://site.net/es/a", "https://site.net/fr", "https://net/fr/", "https://x.net", "https://x.org/es/?a", "ftp://com", "com/", "", None, "://com/", "a://b://com/c",
    "http://ÉXAMPLE.com/ñ", "http://x.com?y/z", "http://x.com#/a", "HTTP://X.COM/ÄB\nc", "http://" + "a" * 50_000 + ".com/" + "b/" * 1000,
]


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS))
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("extra") for c in ("host", "path", "rule", "text", "verdict", "score", "fit", "gram")})
    out = judge_urls(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path = parts(URLS[r.page_id])
        verdict, rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    expected = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op9_url_filter']})").fetchall(), key=str)
    assert sorted(map(tuple, op9_url_filter(spark, f"/root/testdata/{sf}").collect()), key=str) == expected


def test_the_model_tells_kinds_apart(spark):
    """URLs that no rule fits score by the kind they look like; a joined model gives what a broadcast one does."""
    good = [f"http://shop{i}.com/garden/tools/item{i}" for i in range(200)]
    bad = [f"http://w{i}.net/es/zzqqxx/zzqq{i}" for i in range(200)]
    asked = [f"http://shop{i}.org/garden/tools/item{i}" for i in range(40)] + [f"http://w{i}.org/es/zzqqxx/zzqq{i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id long, url string")
    out = {r.page_id: r for r in judge_urls(pages).collect()}
    assert min(out[400 + i].score for i in range(40)) > 0 > max(out[440 + i].score for i in range(40))
    assert all((out[440 + i].verdict, out[440 + i].rule) == ("block", None) for i in range(40))
    assert {r.page_id: r for r in judge_urls(pages, broadcast_grams=0).collect()} == out


def test_awkward_rows_and_an_empty_table(spark):
    pages = spark.createDataFrame([(None, None), (1, None), (1, None), (2, ""), (3, "http://a.org/b")], "page_id long, url string")
    out = judge_urls(pages).collect()
    assert len(out) == 5 and {r.verdict for r in out} == {"allow"}  # nothing to learn from
    assert judge_urls(pages.limit(0)).count() == 0
