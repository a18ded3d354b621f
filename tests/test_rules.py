import pytest
from pyspark.sql import functions as F

from auditlake.functions.html_facts import extract, facts
from auditlake.operators import rules, score

GOOD = """<!doctype html><html><head><title>A page with a title of a good length</title>
<meta name="description" content="A description that is long enough to be useful to everybody.">
<link rel="canonical" href="https://example.com/"><meta property="og:title" content="t"><meta property="og:description" content="d">
<meta property="og:image" content="i"><meta property="og:url" content="u"><meta name="twitter:card" content="c"></head>
<body><h1>One</h1><h2>Two</h2><p>Text</p><img src="/a.png" alt="A photo"><a href="/about">About</a></body></html>"""


def check_ids(spark, html, url="https://example.com/", chain=(), names=None):
    df = spark.createDataFrame([(url, list(chain), html)], "url string, redirect_chain array<string>, html string")
    return [r.check_id for r in rules.exploded(rules.page_findings(extract(df, ["url", "redirect_chain"]), names), ["url"]).collect()]


def test_good_page_has_no_findings(spark):
    assert check_ids(spark, GOOD) == []


@pytest.mark.parametrize(
    ("html", "rule", "want"),
    [
        ("<p>x</p>", "title", ["title.missing"]), ("<title> \n</title>", "title", ["title.empty"]), ("<title>short</title>", "title", ["title.short"]), (f"<title>{'x' * 61}</title>", "title", ["title.long"]),
        (f"<title>{'&amp;' * 30}</title>", "title", []),
        ("", "description", ["description.missing"]), ('<meta name="description"><meta name="description" content="later">', "description", ["description.missing"]),
        ('<meta name="description" content=" ">', "description", ["description.empty"]), ('<meta name="description" content="abc">', "description", ["description.short"]), (f'<meta name="description" content="{"x" * 161}">', "description", ["description.long"]),
        ("", "canonical", ["canonical.missing"]), ('<link rel="canonical" href="/x">', "canonical", ["canonical.invalid"]), ('<link rel="canonical" href="https://other.example/">', "canonical", ["canonical.off-host"]),
        ('<link rel="canonical" href="/landing">', "canonicals", ["canonical.not-self-referential"]), ('<link rel="canonical" href="/"><link rel="canonical" href="/b">', "canonicals", ["canonical.multiple"]),
        ("<h2>x</h2>", "headings", ["headings.no-h1"]), ("<h1>a</h1><h1>b</h1>", "headings", ["headings.multiple-h1"]), ("<h1>a</h1><h3></h3>", "headings", ["headings.empty", "headings.skipped-level"]), ("<h3>c</h3><h1>a</h1><h2>b</h2>", "headings", []),
        ('<script src="http://a/x.js"></script><link href="http://a/c.css"><img src="HTTP://a/i">', "https", ["https.mixed-content"] * 2), ('<object data="http://a/o"></object><img src="//a/b">', "https", ["https.mixed-content"]),
        ("", "social", ["og.title.missing", "og.description.missing", "og.image.missing", "og.url.missing", "twitter.card.missing"]),
        ('<img src="a.png"><img src="b.png" alt=""><img src="c.png" alt=" "><img src="data:x">', "images", ["images.missing-alt", "images.empty-alt"]),
        ('<div id="root"></div><script>var a = "' + "x" * 500 + '";</script>', "scripted", ["js-rendered.likely"]), ("", "scripted", []),
    ],
)
def test_rules(spark, html, rule, want):
    assert check_ids(spark, html, names=[rule]) == want


def test_rules_on_addresses(spark):
    assert check_ids(spark, GOOD, "http://example.com/", names=["https"]) == ["https.insecure"]
    hop = [f"https://example.com/{i}" for i in range(6)]
    assert check_ids(spark, GOOD, chain=hop, names=["redirects"]) == ["redirects.chain-excessive"]
    assert check_ids(spark, GOOD, chain=hop[:4], names=["redirects"]) == ["redirects.chain-long"]
    assert check_ids(spark, GOOD, chain=hop[:3], names=["redirects"]) == []
    old = '<link rel="canonical" href="https://example.com/old">'
    assert check_ids(spark, old, "https://example.com/new", ["https://example.com/old"], ["canonicals"]) == ["canonical.redirect-mismatch"]


def test_nulls_and_strange_html(spark):
    assert "title.missing" in check_ids(spark, None, None)
    assert check_ids(spark, "<title>&eacute;" + "<" * 500, names=["headings"]) == ["headings.no-h1"]
    long = GOOD.replace("Text", "word " * 200_000)
    assert check_ids(spark, long) == []


def test_facts_ignore_raw_text():
    f = facts('<script>var t = "<h1>no</h1>"</script><!-- <h1>no</h1> --><noscript><img src=x></noscript><style>p{}</style><p>é</p>')
    assert f["headings"] == [] and f["images"] == [] and f["text_bytes"] == 2 and f["content_tags"] == 1


def test_own_rule_can_be_added(spark):
    @rules.rule("has-text")
    def has_text(f, url, chain):
        return rules.first_of((f["text_bytes"] == 0, rules.finding("text.none", "Structure", rules.INFO, "No text", 1)))

    try:
        assert check_ids(spark, "", names=["has-text"]) == ["text.none"]
    finally:
        del rules.RULES["has-text"]


def test_scores(spark):
    def scored(*findings):
        df = spark.createDataFrame([(list(findings),)], f"findings array<{rules.FINDING}>")
        r = score.with_scores(df).collect()[0]
        return r.score, r.category_scores

    assert scored()[0] == 100 and set(scored()[1].values()) == {100}
    total, per = scored(("a", "Metadata", "Warning", "m", 30))
    assert total == 94 and per["Metadata"] == 70
    assert scored(("a", "Media", "Critical", "m", 255))[1]["Media"] == 0
    # 9150 / 100 is an exact half and rounds up.
    assert scored(("a", "Metadata", "Warning", "m", 30), ("b", "SocialTags", "Info", "m", 50))[0] == 92


def test_site_scores_truncate(spark):
    df = spark.createDataFrame([("a", 100), ("a", 81), ("b", None)], "k string, score int")
    assert {r.k: r.site_score for r in score.site_scores(df, "k").collect()} == {"a": 90, "b": 0}
    means = spark.createDataFrame([("a", "Media", 84), ("a", "Media", 85)], "k string, category string, score int")
    assert score.category_means(means, "k").select("mean", "bar").collect() == [(84, 8)]
    assert [r[0] for r in spark.createDataFrame([(90,), (70,), (69,)], "s int").select(score.band(F.col("s"))).collect()] == ["good", "fair", "poor"]
