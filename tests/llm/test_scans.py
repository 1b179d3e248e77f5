import collections
import hashlib
import re

import pytest

from isomere.llm import secret_scan, url_filter


def brute_spans(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), k, m.end(), r))
    return sorted(out, key=lambda s: s[:3])


def spell(found):
    return ",".join(f"{r.kind}:{s}:{e}" for s, _, e, r in found)


def test_secret_scan(docs, rows, spark):
    extra = [
        (200, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20, "en"), (201, "API_KEY:abcdef apikey: 'x' Secret=\"ABCDEF123\" passwordpassword=longenough", "en"),
        (202, "AKIA" + "Z" * 15 + " AKIA" + "Z" * 16 + " deadbeef" * 4 + " " + "f" * 24, "en"), (203, "ſecret=abcdefgh 😀 token=abcdefgh", "en"), (None, "password=abcdefgh", "en"),
        (204, "http://user:pw123@host/ xoxb-1234567890-abc", "en"),
    ]
    frame = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string"))
    got = sorted(((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_scan.secret_scan(frame).collect()))
    want = []
    for i, text in [(r[0], r[1]) for r in rows] + [(r[0], r[1]) for r in extra]:
        found = brute_spans(text, secret_scan.RULES)
        base = [f for f in found if f[3].base]
        n = collections.Counter(f[3].kind for f in found)
        want.append((i or -1, n["assign"], n["access"], n["hex"], hashlib.sha256(spell(base).encode()).hexdigest(), spell(found)))
    assert got == sorted(want)


@pytest.mark.parametrize("pattern, texts", [
    (r"(?:foo|barbaz)\d+", ["foo1", "barbaz22"]), (r"ab?cde", ["abcde", "acde"]), (r"x[yz]{2}wv", ["xyywv", "xyzwv"]), (r"[a-z]+", ["q"]), (r"(key)=.*end", ["key=1 end"]),
])
def test_trigram_query_is_necessary(pattern, texts):
    query = secret_scan.trigram_query(pattern)
    for text in texts:
        assert re.search(pattern, text)
        assert all(any(all(t in text.lower() for t in s) for s in sets) for sets in query)


def test_secret_scan_empty(none):
    assert secret_scan.secret_scan(none).count() == 0


URLS = [
    ("http://www.Example.COM/en/712?x", "www.example.com", "/en/712", "example.com/en/7", "allow"), ("http://example.com/en/12", "example.com", "/en/12", "com/en/", "block"),
    ("ftp://a.b.net/de/1#f", "a.b.net", "/de/1", "net/de/", "block"), ("x://example.net/de/88", "example.net", "/de/88", "example.net/de/8", "block"),
    ("http://notexample.net", "notexample.net", "", None, "allow"), ("http://fooorg/es/", "fooorg", "/es/", None, "allow"), ("http://org/es/", "org", "/es/", "org/es/", "block"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://ÀB.com?/en/", "Àb.com", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "x"), (None, URLS[1][0], "x")], "page_id bigint, url string, host string")
    none = spark.createDataFrame([], "url string, block boolean")
    got = url_filter.url_filter(pages, none).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:]


def test_url_mined_rules(spark):
    urls = [(f"http://casino{i % 3}.example.io/win/{i}?ref=a", True) for i in range(60)] + [(f"http://news{i % 3}.example.io/win/{i}", False) for i in range(60)] + [(f"http://news.example.io/sport/{i}?ref=a", False) for i in range(60)]
    labelled = spark.createDataFrame(urls, "url string, block boolean")
    pages = spark.createDataFrame([(1, "https://other.example.io/win/7?ref=b"), (2, "https://other.example.io/win/7"), (3, "http://casino1.example.io/x")], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, labelled).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


def test_url_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.url_filter(pages, spark.createDataFrame([], "url string, block boolean")).count() == 0
