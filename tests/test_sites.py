"""robots.txt, sitemaps, redirects, retries, charsets, links, crawl."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.operators import frontier, links, robots, sitemap
from auditlake.sources import recorded


@pytest.mark.parametrize(
    ("body", "every", "site_map"),
    [
        ("User-agent: *\nDisallow: /\nSitemap: https://a.example/s.xml", True, True), ("USER-AGENT: *\r\nDISALLOW: /\r\nSITEMAP: /s", True, True), ("User-agent: Googlebot\nDisallow: /\nSitemap: x", False, True),
        ("User-agent: *\nAllow: /\n\nUser-agent: Badbot\nDisallow: /", False, False), ("User-agent: *\n# note\nDisallow: /", False, False), ("", False, False), (None, False, False),
    ],
)
def test_robots_parse(body, every, site_map):
    p = robots.parse(body)
    assert (p["disallow_all"], p["has_sitemap"]) == (every, site_map)


def test_robots_blocks():
    p = robots.parse("User-agent: a\nDisallow: /x\nUser-agent: b\nDisallow: /y\nDisallow:\n\nCrawl-delay: 9\nUser-agent: c\nCrawl-delay: 2\nCrawl-delay: z")
    assert {(r["ua"], r["prefix"]) for r in p["rules"]} == {("a", "/x"), ("a", "/y"), ("b", "/x"), ("b", "/y")}
    assert p["delays"] == [{"ua": "c", "secs": 2.0}]


def decide(spark, body, path, ua="auditlake/1"):
    rows = [("h", r["ua"], r["kind"], r["prefix"]) for r in robots.parse(body)["rules"]]
    rules = spark.createDataFrame(rows, "host string, ua string, kind string, prefix string")
    return robots.decisions(spark.createDataFrame([("h", path)], "host string, path string"), rules, ua).collect()[0].allowed


def test_robots_decisions(spark):
    longest = "User-agent: *\nDisallow: /private\nAllow: /private/public"
    assert decide(spark, longest, "/private/public/page") and not decide(spark, longest, "/private/secret")
    own = "User-agent: *\nDisallow: /private\n\nUser-agent: Auditlake\nAllow: /private"
    assert decide(spark, own, "/private/x")
    assert decide(spark, "User-agent: *\nDisallow: /a\nAllow: /a", "/a/b")
    assert decide(spark, "", "/") and decide(spark, longest, None)


def test_window_parser_agrees(spark):
    bodies = ["User-agent: a\nDisallow: /x\nUser-agent: B\nAllow: /y", "User-agent: *\n# note\nDisallow: /", "UA: x\r\nUser-agent: *\r\nDISALLOW: /p # c\r\n", "", "Disallow: /z"]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "host string, body string")
    want = sorted((str(i), r["ua"], r["kind"], r["prefix"]) for i, b in enumerate(bodies) for r in robots.parse(b)["rules"])
    assert sorted(map(tuple, robots.rule_rows(df).collect())) == want


def test_sitemaps():
    head = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    assert sitemap.read(head + "<url><loc>https://a.example/1</loc></url><url><loc> not a url </loc></url><url><loc>https://a.example/2</loc></url></urlset>") == (True, ["https://a.example/1", "https://a.example/2"])
    assert len(sitemap.read(head + "".join(f"<url><loc>https://a.example/{i}</loc></url>" for i in range(60)) + "</urlset>")[1]) == 50
    assert sitemap.read("<sitemapindex><sitemap><loc>https://a.example/s</loc></sitemap></sitemapindex>") == (True, [])
    assert sitemap.read("<urlset><url>")[0] is False and sitemap.read("<a><b></a></b>")[0] is False
    assert sitemap.read("") == (True, []) and sitemap.read(None) == (True, []) and sitemap.read("text") == (True, [])
    assert sitemap.sitemap_url("Sitemap: /m.xml", "https://a.example/") == "https://a.example/m.xml"
    assert sitemap.sitemap_url(None, "https://a.example/x") == "https://a.example/sitemap.xml"


RESPONSE = "method string, url string, status int, location string, headers map<string,string>, body binary, error string, attempt int"


def web(spark, *rows):
    return spark.createDataFrame([(r.get("method", "GET"), "https://a.example" + r["at"], r.get("status", 200), r.get("to"), r.get("headers", {}), r.get("body", b""), r.get("error"), r.get("attempt", 0)) for r in rows], RESPONSE)


def fetch(spark, at, *rows):
    seeds = spark.createDataFrame([("https://a.example" + at,)], "requested string")
    return recorded.fetch(seeds, web(spark, *rows)).collect()[0]


def test_redirects(spark):
    hops = [{"at": "/1", "status": 301, "to": "/2"}, {"at": "/2", "status": 302, "to": "https://a.example/3"}, {"at": "/3", "status": 307, "to": "/end"}, {"at": "/end", "body": b"hi"}]
    r = fetch(spark, "/1", *hops)
    assert (r.url, r.redirect_chain, r.html, r.error) == ("https://a.example/end", [f"https://a.example/{i}" for i in (1, 2, 3)], "hi", None)
    assert fetch(spark, "/l", {"at": "/l", "status": 301, "to": "/l"}).error == "RedirectLoop"
    assert fetch(spark, "/0", *[{"at": f"/{i}", "status": 301, "to": f"/{i + 1}"} for i in range(12)]).error == "RedirectLoop"
    assert fetch(spark, "/n", {"at": "/n", "status": 304}).status == 304
    assert fetch(spark, "/missing", {"at": "/x"}).error == "NotRecorded"
    assert fetch(spark, "/e", {"at": "/e", "status": None, "error": "timeout"}).error == "timeout"


def test_retries(spark):
    assert fetch(spark, "/r", {"at": "/r", "status": 429}, {"at": "/r", "status": 200, "attempt": 1, "body": b"ok"}).html == "ok"
    assert fetch(spark, "/r", *[{"at": "/r", "status": 503, "attempt": i} for i in range(4)]).status == 503
    waits = spark.createDataFrame([("7", 0), (None, 0), ("x", 2)], "h string, a int").select(recorded.retry_wait(F.col("h"), F.col("a"))).collect()
    assert [w[0] for w in waits] == [7, 1, 4]


def test_charsets():
    text = "日本語のページ"
    assert recorded.decode_body(b'<meta charset="shift_jis">' + text.encode("shift_jis"), "text/html").endswith(text)
    assert recorded.decode_body("naïve".encode("cp1252"), "text/html; charset=windows-1252") == "naïve"
    assert recorded.decode_body("naïve".encode(), "text/html; charset=x-none") == "naïve"
    assert recorded.decode_body(b"\xff", None) == "�" and recorded.decode_body(None, None) == ""
    assert recorded.headers_of([("A", "1"), ("a", "2"), ("B", "é")]) == {"a": "2"}


def test_probes(spark):
    rows = [
        {"method": "HEAD", "at": "/ok"}, {"method": "HEAD", "at": "/404", "status": 404}, {"method": "HEAD", "at": "/500", "status": 500}, {"method": "HEAD", "at": "/405", "status": 405}, {"at": "/405"},
        {"method": "HEAD", "at": "/err", "status": None, "error": "x"}, {"at": "/err", "status": None, "error": "x"}, {"method": "HEAD", "at": "/999", "status": 999},
    ]
    pages = spark.createDataFrame([(1, [f"https://a.example{p}" for p in ("/ok", "/404", "/500", "/405", "/err", "/999", "/none")], ["https://b.example/"]), (2, None, None)], "page_key int, internal array<string>, external array<string>")
    found = links.link_rows(pages, "page_key")
    got = sorted(r.check_id for r in links.link_findings(found, links.probe(found, web(spark, *rows)), "page_key").collect())
    assert got == ["links.broken-4xx", "links.broken-5xx"] + ["links.unreachable"] * 3
    assert links.link_rows(pages, "page_key", external=True).count() == 8


def test_crawl(spark):
    edges = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("b", "d", 0), ("c", "r", 0), ("a", "b", 1), (None, "x", 0), ("r", None, 2), ("r", "a", 5)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("j", "r"), ("j", "r"), ("j", None)], "job_id string, url string")
    got = {r.url: r.depth for r in frontier.crawl(seeds, edges, 2).collect()}
    assert got == {"r": 0, "a": 1, "b": 1, "c": 2, "d": 2}
    assert {r.url for r in frontier.crawl(seeds, edges, 2, max_pages=2).collect()} == {"r", "a"}
    assert {r.url for r in frontier.crawl(seeds, edges, 2, max_pages=0).collect()} == {"r"}
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "src string, dst string")
    found = {r.url: (r.final, r.chain, r.is_loop) for r in frontier.resolve_redirects(spark.createDataFrame([("a",), ("x",), ("z",)], "url string"), hops).collect()}
    assert found == {"a": ("c", ["a", "b"], False), "x": ("x", ["x"], True), "z": ("z", [], False)}


def test_link_columns(spark):
    df = spark.createDataFrame([("https://a.example/p", ["/x", "#f", "https://b.example/", None]), (None, ["/x"]), ("https://a.example/", None)], "url string, links array<string>")
    rows = urls.with_links(df).collect()
    assert (rows[0].internal, rows[0].external, rows[0].discovered) == (["https://a.example/x"], ["https://b.example/"], ["https://a.example/x", "https://a.example/p"])
    assert rows[1].internal == [] and rows[2].discovered == []


def test_sitemap_bodies_hold_all_urls_of_a_host(spark, tmp_path, monkeypatch):
    from auditlake.plans import core

    spark.createDataFrame([("h", f"https://h/{i:03}") for i in range(100)], "host string, url string").write.parquet(f"{tmp_path}/page.parquet")
    assert core.sitemap_locs(spark, str(tmp_path)).count() == 50
    monkeypatch.setattr(core.sitemap, "read_sitemap", lambda body: F.struct(F.regexp_extract_all(body, F.lit("<loc> (.*?) </loc>")).alias("locs")))
    assert [r.loc for r in core.sitemap_locs(spark, str(tmp_path)).orderBy("pos").collect()] == [f"https://h/{i:03}" for i in range(100)]
