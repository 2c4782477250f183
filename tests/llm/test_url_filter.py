import re

from pyspark.sql import functions as F

from gatewarden.llm import url_filter as u
from gatewarden.llm.queries import URL_RULES

URLS = [
    "http://com/", "http://com", "https://Shop.COM/a", "http://www.example.com/en/x", "http://a.www.example.com/en/",
    "http://example.com/en/1", "http://m.example.com/en", "http://m.example.com/en/2?x#y", "http://example.com/enx",
    "http://x.net/es/1", "http://net/fr/", "http://x.net/fr", "http://x.net:80/es/1", "http://user@x.net/es/",
    "http://notnet/es/", "no scheme net/es/", "://net/es/", "a://b://c.com/", "http://x.com?q=/en/", "http://x.com#/en/",
    "http://x.org/\nline?z", "", None, "http://", "http:///path", "HTTP://ÄB.COM/É",
    "http://long.example.net/" + "a" * 50_000,
]


def plain(url):
    found = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[2], found[3]) if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(rule), rule, verdict)
        for verdict, rule in URL_RULES
        for h, p in [rule.split("/", 1)]
        if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}")
    ]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_match_a_plain_version(spark):
    pages = spark.createDataFrame([(i, url, "clash") for i, url in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string")
    got = u.judged(pages, URL_RULES, u.labelled(spark)).collect()
    assert len(got) == len(URLS) + 3
    for r in got:
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.p_block > 0.5 else "allow"))
    assert u.judged(pages.limit(0), URL_RULES, u.labelled(spark)).count() == 0


def test_regression_tells_kinds_of_hosts_apart(spark):
    bad = ["https://www.spam-farm.test.org/en/9", "http://casino-win.other.net/de/4", "https://ads-track.test.org/x"]
    good = ["https://www.riverside.test.org/en/9", "http://blog.mountain.test.net/de/4", "https://choir.test.org/x"]
    pages = spark.createDataFrame([(url,) for url in bad + good], "url string")
    got = {r.url: r.verdict for r in u.judged(pages, (), u.labelled(spark)).collect()}
    assert [got[x] for x in bad + good] == ["block"] * 3 + ["allow"] * 3


def test_one_class_or_none_to_learn(spark):
    pages = spark.createDataFrame([("http://a.org/",), (None,)], "url string")
    empty = u.labelled(spark, []).union(spark.createDataFrame([(None, "block"), ("http://x", None)], "url string, label string"))
    assert {r.verdict for r in u.judged(pages, (), empty).collect()} == {"allow"}
    assert {r.verdict for r in u.judged(pages, (), u.labelled(spark, [("http://x", "block")])).collect()} == {"block"}
