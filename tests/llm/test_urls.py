from __future__ import annotations

import re

import oracle

from tessera.llm import queries, urls
from tessera.llm.common import read

SF = "/root/testdata/sf0.01"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for r in urls.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    text = "".join(c.lower() if c.isascii() else c for c in host + path)
    count = lambda t: len(re.findall(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text))
    own = "block" if any(map(count, urls.STRICT)) or sum(map(bool, map(count, urls.SOFT))) >= 2 else "allow"
    return host, path, best and best.name, best.verdict if best else own


def test_whole_table_and_sql(spark):
    pages = read(spark, SF, "pages")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    assert got == {r["page_id"]: brute(r["url"]) for r in pages.collect()}
    assert {v[3] for v in got.values()} == {"allow", "block"}
    sql = queries.oracle_sql()["op8_url_vocabulary"]
    assert oracle.compare(queries.op8_url_vocabulary(spark, SF), oracle.connect(SF), sql) is None


def test_edge_rows(spark):
    given = [None, "", "no scheme", "://", "HTTP://EXAMPLE.NET/EN/x", "http://Example.Net/en/", "http://net", "http://net/", "http://x.net?q", "http://notexample.net/en/", "http://a.example.com/de/xxx", "http://xxx.org/fr/", "http://a/cheap/free", "http://a/cheap/cheap", "http://a/casinos", "http://a/casino", "http://a/x-casino_y", "http://a.org/" + "p/" * 50_000, "http://b/CASINO", "a://b://c/d"]
    rows = [(i, u, "h") for i, u in enumerate(given)] + [(3, given[3], "h"), (None, "http://a/", "h")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(given[r["page_id"]])
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_counts():
    v = urls.Vocabulary(("casino",), ("free", "win"), 2)
    assert v.hits("casino.casino/xcasino") == (2, 0)
    assert v.hits("free-free/win") == (0, 2) and v.rejects("free/win") and not v.rejects("free/free")
