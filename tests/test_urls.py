from urllib.parse import unquote, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from tessella.functions import urls

URLS = [
    "https://Example.COM/News/?q=A#Top", "HTTP://example.com:80/a//b///", "https://user:pw@example.com:8443/x/", "http://example.com", "https://example.com/", "//cdn.example.com/a.js", "/relative/path/", "mailto:a@b.c", "  https://example.com/trim  ",
    "https://example.com/a%20b/%D0%BF/+x%zz", "https://example.com/é/ü", "https://example.com/?a=1&a=2&b=&c", "https://[::1]:8080/x", "", "not a url", "https://example.com?x=1", "https://example.com/a?b#c?d",
]


def values(spark, column):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "k int, u string")
    return [r.v for r in df.select("k", column(F.col("u")).alias("v")).orderBy("k").collect()]


def test_split_like_the_standard_library(spark):
    for name, get in (("scheme", lambda p: p.scheme), ("netloc", lambda p: p.netloc), ("path", lambda p: p.path), ("query", lambda p: p.query), ("fragment", lambda p: p.fragment), ("host", lambda p: p.hostname or "")):
        got = values(spark, lambda u, name=name: getattr(urls, name)(urls.stripped(u)))
        assert got == [get(urlsplit(u.strip())) for u in URLS], name


def reference_norm(u):
    u = u.strip()
    if not u:
        return ""
    p = urlsplit(u)
    return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/"), p.query, p.fragment))


def test_norm_url(spark):
    assert values(spark, urls.norm_url) == [reference_norm(u) for u in URLS]


def test_sitemap_key_and_join_key(spark):
    got = dict(zip(URLS, values(spark, urls.sitemap_key)))
    assert got["https://Example.COM/News/?q=A#Top"] == "https://example.com/News?q=A"
    assert got["HTTP://example.com:80/a//b///"] == "http://example.com/a//b"
    assert got["https://user:pw@example.com:8443/x/"] == "https://user:pw@example.com:8443/x"
    assert got["https://example.com/"] == "https://example.com/" and got["http://example.com"] == "http://example.com"
    assert [got[u] for u in ("/relative/path/", "", "not a url", "mailto:a@b.c", "//cdn.example.com/a.js")] == [None] * 5
    loose = dict(zip(URLS, values(spark, lambda u: urls.join_key(u, ignore_query=True, ignore_scheme=True, casefold_path=True))))
    assert loose["https://Example.COM/News/?q=A#Top"] == "https://example.com/news" and loose["HTTP://example.com:80/a//b///"] == "https://example.com/a//b"


def test_crawl_key_keeps_all_but_the_fragment(spark):
    got = dict(zip(URLS, values(spark, urls.crawl_key)))
    assert got["https://Example.COM/News/?q=A#Top"] == "https://Example.COM/News/?q=A" and got["http://example.com"] == "http://example.com/"


def test_decoded_path(spark):
    assert values(spark, lambda u: urls.decoded_path(urls.stripped(u))) == [unquote(urlsplit(u.strip()).path) for u in URLS]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x/blog/how-to-fix-pumps", "https://x/blog/*"), ("https://x/documentation", "https://x/documentation"), ("https://x/p/123/?q=1#f", "https://x/p/*/"), ("https://x/2024-01-02/short", "https://x/*/short"),
        ("https://x/a/0f8fad5b-d9cb-469f-a165-70867728950e", "https://x/a/*"), ("https://x", "https://x"),
    ],
)
def test_url_pattern(spark, url, want):
    assert spark.range(1).select(urls.url_pattern(F.lit(url))).first()[0] == want


@pytest.mark.parametrize(("url", "want"), [("https://x/?page=2", 2), ("https://x/page/3/", 3), ("https://x/page/3/?page=3", 3), ("https://x/page/2/?paged=5", None), ("https://x/", None), ("https://x/?page=", None), ("https://x/pg/7", 7)])
def test_page_number(spark, url, want):
    assert spark.range(1).select(urls.page_number(F.lit(url))).first()[0] == want


def test_tracking_parameters_need_a_value(spark):
    got = spark.range(1).select(urls.tracking_parameters(F.lit("https://x/?utm_source=a&gclid=&fbclid=1&x=2&UTM_Medium=b"))).first()[0]
    assert got == ["utm_source", "fbclid", "UTM_Medium"]


@pytest.mark.parametrize(("host", "want"), [("www.shop.example.co.uk", "example.co.uk"), ("a.b.example.com", "example.com"), ("me.github.io", "me.github.io"), ("x.me.github.io", "me.github.io"), ("localhost", "localhost"), ("b.s3.amazonaws.com", "b.s3.amazonaws.com")])
def test_registrable_domain(spark, host, want):
    assert spark.range(1).select(urls.registrable_domain(F.lit(host))).first()[0] == want


def test_loopback_and_kinds(spark):
    one = spark.range(1)
    assert [one.select(urls.is_loopback(F.lit(h))).first()[0] for h in ("localhost", "a.localhost", "127.0.0.1", "127.8.8.8", "::1", "example.com", "127.example.com")] == [True] * 5 + [False] * 2
    assert [one.select(urls.url_kind(F.lit(u))).first()[0] for u in ("https://x/", "https://x/a/b.html", "https://x/a/", "x")] == ["folder", "finalUrl", "folder", "finalUrl"]
