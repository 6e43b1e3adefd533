import re

from msgledger.llm import urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "a.b.example.org/x"), ("allow", "b.example.org/xyz"), ("block", "same.org/"), ("allow", "same.org/")]


def brute(url):
    m = re.search(r"://(.*)", url or "", re.S)
    rest = re.split(r"[?#]", m[1])[0] if m else ""
    host, slash, path = rest.partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = []
    for action, text in RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(h) + len(p) + 1, len(h), action == "block", text, action))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    "http://Example.NET/en/1?x=/de/",
    "https://www.example.net/de/",
    "http://example.net",
    "http://example.net?q",
    "http://example.com/de/#frag",
    "http://example.com/DE/",
    "http://a.org/fr/x://y/z",
    "http://c.a.b.example.org/xyz/1",
    "http://b.example.org/xy",
    "http://same.org/",
    "http://xnet/",
    "http://net/",
    "no scheme",
    "://",
    "ftp://u@h:80/p",
    "http:///path",
    "",
    None,
    "http://ÄX.net/é",
    "http://a..net/\nx",
    "http://net./",
    "http://" + "a." * 60 + "net/" + "p/" * 3000,
]


def test_against_brute_force(spark):
    rows = [(i, u, "extra", "clash") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "e", "c"), (0, URLS[0], "e", "c"), (0, URLS[0], "e", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    got = urls.judge_urls(pages, urls.rule_table(spark, RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((r[0], *brute(r[1])) for r in rows), key=key)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge_urls(pages, urls.rule_table(spark, RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    got = urls.judge_urls(one, spark.createDataFrame([(None, "/", "block")], urls.RULES)).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
        got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(pages, urls.rule_table(spark, RULES)).collect()}
        assert got == {i: brute(u) for i, u in enumerate(URLS)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_rules(spark):
    one = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id bigint, url string")
    got = sorted(map(tuple, urls.judge_urls(one, spark.createDataFrame([], urls.RULES), default="block").collect()))
    assert got == [(1, "a.net", "/x", None, "block"), (2, "", "", None, "block")]
