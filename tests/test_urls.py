import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import urls

BASE = "https://example.com/"


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("mailto:a@b.c", None), ("tel:1", None), ("javascript:void(0)", None), ("data:text/plain,x", None), ("ftp://example.com/a", None),
        ("/about", "https://example.com/about"), ("/page#section", "https://example.com/page"), ("/p?utm_source=a&utm_x=b", "https://example.com/p"),
        ("/p?fbclid=1&gclid=2&mc_eid=3&ref=4&igshid=5", "https://example.com/p"), ("/p?id=42&utm_source=g&ref=home", "https://example.com/p?id=42"),
        ("/s?z=last&a=first&m=mid", "https://example.com/s?a=first&m=mid&z=last"), ("//other.example.com/bar", "https://other.example.com/bar"),
        ("https://example.com", "https://example.com/"), ("/p?a", "https://example.com/p?a="), ("#top", "https://example.com/"), ("", "https://example.com/"),
        ("HTTP://EXAMPLE.com:80/A b/é?q=ü x", "http://example.com/A%20b/%C3%A9?q=%C3%BC+x"), ("a/../b/./c", "https://example.com/b/c"), ("\\x\\y", "https://example.com/x/y"),
        ("https://exa mple.com/", None), ("https://example.com:99999/", None), ("/a//b", "https://example.com/a//b"), ("/p?b=2&a=1&b=1", "https://example.com/p?a=1&b=2&b=1"), (None, None),
    ],
)
def test_normalise(href, want):
    assert urls.normalise(BASE, href) == want


def test_relative_base():
    assert urls.normalise("https://example.com/blog/post", "../news") == "https://example.com/news"
    assert urls.normalise("https://example.com/blog/post", "next") == "https://example.com/blog/next"
    assert urls.normalise("not a url", "/x") is None
    assert urls.normalise(None, "/x") is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_normalise_is_idempotent(href):
    once = urls.normalise(BASE, href)
    assert once is None or urls.normalise(BASE, once) == once


def test_same_site():
    assert urls.same_site("https://a.example/x", "http://a.example:8080/")
    assert not urls.same_site("https://www.a.example/", "https://a.example/")
    assert not urls.same_site(None, "https://a.example/")


def test_discover_and_partition():
    hrefs = ["/ok", "/ok", "https://example.com/abs", "#here", "mailto:x@y.z", "https://other.example/"]
    assert urls.discover(BASE, hrefs) == ["https://example.com/ok", "https://example.com/abs", "https://example.com/"]
    assert urls.partition_links(BASE, hrefs) == (["https://example.com/ok", "https://example.com/abs"], ["https://other.example/"])


def test_columns(spark):
    df = spark.createDataFrame([("https://A.example:443/x?b=1&a=2#f", "/y?utm_a=1"), (None, None), ("::", "x")], "u string, h string")
    rows = df.select(urls.url_parts("u").alias("p"), urls.normalise_url("u", "h").alias("n"), urls.simple_normalise(F.col("u")).alias("s")).collect()
    assert (rows[0].p.host, rows[0].p.port, rows[0].p.fragment) == ("a.example", None, "f")
    assert rows[0].n == "https://a.example/y" and rows[1].n is None and rows[2].p.host is None
    assert rows[0].s == "https://a.example:443/x?a=2&b=1"
