import re

from tallymark.llm.urls import RULES, judge_urls


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, v) for v, h, p in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, max(fits, default=(0, None, None))[1:]


URLS = [
    "http://a.example.com/en/1?x=1", "https://WWW.Example.com/en/x#t", "http://example.com", "http://example.com/",
    "http://x.net/es/", "http://net/fr/1", "http://badnet/es/", "http://a.b.c.example.org/q", "mailto:x", None, "",
    "://", "x://y://z/en/", "http://example.com?u=/en/", "http://É.com/en/ü", "ftp://notexample.com/en/",
    "http://" + ".".join(["a"] * 3000) + ".com/z", "http://m.x.net/en/", "http://m.x.net/en/",
]


def test_rules_and_odd_urls(spark):
    rows = [(i, u, None if i % 2 else "<a href='/x'>") for i, u in enumerate(URLS)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 AS host", "2 AS path", "3 AS rule", "4 AS links", "5 AS n", "6 AS id"
    )
    got = judge_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, (rule, verdict) = brute(URLS[r.page_id] if r.page_id is not None else None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        if not host:
            assert r.verdict == "allow"
    assert judge_urls(pages.limit(0)).count() == 0


def test_distrust_runs_against_links_and_trust_along(spark):
    rows = [
        (0, "http://bad.net/es/1", ""),
        (1, "http://linker.org/1", '<a href="http://bad.net/x">'),
        (2, "http://good.com/1", "<a href='https://Friend.org/y'>"),
        (3, "http://friend.org/1", ""),
        (4, "http://far.org/1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    assert {i: r.verdict for i, r in got.items()} == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow"}
    assert got[1].distrust > 0 and got[3].trust > 0 and got[4].trust == 0
