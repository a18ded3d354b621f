"""Rules on pages as column expressions: each gives an array of findings from a page's facts.

A rule is registered under its name with ``@rule``; further rules can be added the same way. Findings
carry check_id, category, severity, message and penalty.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "struct<check_id:string,category:string,severity:string,message:string,penalty:int>"
#: Categories in their order with their weights in per cent (fixed values).
CATEGORIES = (("Metadata", 20), ("SocialTags", 5), ("Structure", 15), ("Links", 15), ("Media", 10), ("Crawlability", 20), ("Security", 15))
CRITICAL, WARNING, INFO = "Critical", "Warning", "Info"

Rule = Callable[[Column, Column, Column], Column]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    def register(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return register


def finding(check_id: str | Column, category: str, severity: str, message: str | Column, penalty: int) -> Column:
    text = [F.lit(x) if isinstance(x, str) else x for x in (check_id, category, severity, message)]
    return F.struct(text[0].alias("check_id"), text[1].alias("category"), text[2].alias("severity"), text[3].alias("message"), F.lit(penalty).alias("penalty"))


def none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def first_of(*cases: tuple[Column, Column]) -> Column:
    """The finding of the first case that holds, as an array; empty if none does."""
    out = F.when(cases[0][0], F.array(cases[0][1]))
    for condition, found in cases[1:]:
        out = out.when(condition, F.array(found))
    return out.otherwise(none())


def each(values: Column, condition: Callable[[Column], Column], found: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(values, condition), found)


@rule("title")
def title(f: Column, url: Column, chain: Column) -> Column:
    t, n = f["title"], F.char_length(f["title"])
    return first_of(
        (t.isNull(), finding("title.missing", "Metadata", CRITICAL, "Page has no <title> tag", 30)),
        (t == "", finding("title.empty", "Metadata", CRITICAL, "Title tag is empty", 30)),
        (n < 30, finding("title.short", "Metadata", WARNING, F.format_string("Title is %d chars (min 30)", n), 15)),
        (n > 60, finding("title.long", "Metadata", WARNING, F.format_string("Title is %d chars (max 60)", n), 10)),
    )


@rule("description")
def description(f: Column, url: Column, chain: Column) -> Column:
    d, n = f["description"], F.char_length(f["description"])
    return first_of(
        (d.isNull(), finding("description.missing", "Metadata", WARNING, "Page has no meta description", 20)),
        (d == "", finding("description.empty", "Metadata", WARNING, "Meta description is empty", 20)),
        (n < 50, finding("description.short", "Metadata", WARNING, F.format_string("Meta description is %d chars (min 50)", n), 10)),
        (n > 160, finding("description.long", "Metadata", INFO, F.format_string("Meta description is %d chars (max 160)", n), 5)),
    )


@rule("canonical")
def canonical(f: Column, url: Column, chain: Column) -> Column:
    c = f["canonical"]
    return first_of(
        (c.isNull(), finding("canonical.missing", "Metadata", WARNING, "Page has no canonical link", 10)),
        (~f["canonical_readable"], finding("canonical.invalid", "Metadata", WARNING, F.concat(F.lit("Canonical URL is not valid: "), c), 10)),
        (~f["canonical_host"].eqNullSafe(f["host"]), finding("canonical.off-host", "Metadata", WARNING, F.concat(F.lit("Canonical points to different host: "), c), 15)),
    )


@rule("canonicals")
def canonicals(f: Column, url: Column, chain: Column) -> Column:
    n, resolved = F.size(f["canonicals"]), f["resolved"]
    multiple = first_of((n > 1, finding("canonical.multiple", "Metadata", WARNING, F.format_string('Page has %d <link rel="canonical"> elements; only one is expected', n), 10)))
    redirected = F.coalesce(F.array_contains(chain, resolved), F.lit(False))
    other = F.coalesce((f["resolved_host"] == f["host"]) & ~f["resolved_same"], F.lit(False))
    target = first_of(
        (redirected, finding("canonical.redirect-mismatch", "Metadata", WARNING, F.concat(F.lit("Canonical URL "), resolved, F.lit(" matches a redirected URL in the chain")), 15)),
        (other, finding("canonical.not-self-referential", "Metadata", INFO, F.concat(F.lit("Canonical URL "), resolved, F.lit(" differs from the page URL "), url, F.lit(" (same host, different path/query/fragment)")), 5)),
    )
    return F.concat(multiple, target)


@rule("headings")
def headings(f: Column, url: Column, chain: Column) -> Column:
    h = f["headings"]
    ones = F.size(F.filter(h, lambda x: x["level"] == 1))
    count = first_of(
        (ones == 0, finding("headings.no-h1", "Structure", CRITICAL, "Page has no <h1>", 40)),
        (ones > 1, finding("headings.multiple-h1", "Structure", WARNING, F.format_string("Page has %d <h1> elements; expected exactly 1", ones), 20)),
    )
    empty = each(h, lambda x: x["text"] == "", lambda x: finding("headings.empty", "Structure", WARNING, F.concat(F.lit("<h"), x["level"].cast("string"), F.lit("> is empty")), 10))
    levels = F.array_sort(F.array_distinct(F.transform(h, lambda x: x["level"])))
    size = F.size(levels)
    pairs = F.zip_with(F.slice(levels, 1, F.greatest(size - 1, F.lit(0))), F.slice(levels, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    skipped = each(F.when(size > 1, pairs).otherwise(F.array().cast("array<struct<a:int,b:int>>")), lambda p: p["b"] - p["a"] > 1, lambda p: finding("headings.skipped-level", "Structure", WARNING, F.concat(F.lit("Heading level skipped: h"), p["a"].cast("string"), F.lit(" → h"), p["b"].cast("string")), 10))
    return F.concat(count, empty, skipped)


@rule("https")
def https(f: Column, url: Column, chain: Column) -> Column:
    insecure = finding("https.insecure", "Security", CRITICAL, F.concat(F.lit("Page served over "), f["scheme"], F.lit("; HTTPS required")), 40)
    mixed = each(f["resources"], lambda r: r.startswith("http://"), lambda r: finding("https.mixed-content", "Security", WARNING, F.concat(F.lit("Mixed content: http resource on https page — "), r), 20))
    return F.when(f["scheme"].isNull(), none()).when(f["scheme"] != "https", F.array(insecure)).otherwise(mixed)


@rule("social")
def social(f: Column, url: Column, chain: Column) -> Column:
    absent = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    og = [first_of((absent(F.try_element_at(f["properties"], F.lit(f"og:{k}"))), finding(f"og.{k}.missing", "SocialTags", INFO, f"Missing or empty OpenGraph tag: og:{k}", 10))) for k in ("title", "description", "image", "url")]
    card = first_of((absent(F.try_element_at(f["names"], F.lit("twitter:card"))), finding("twitter.card.missing", "SocialTags", INFO, "Missing or empty meta tag: twitter:card", 10)))
    return F.concat(*og, card)


@rule("images")
def images(f: Column, url: Column, chain: Column) -> Column:
    missing = lambda i: finding("images.missing-alt", "Media", WARNING, F.concat(F.lit("Image is missing alt attribute: "), i["src"]), 5)
    empty = lambda i: finding("images.empty-alt", "Media", INFO, F.concat(F.lit("Image has empty alt attribute: "), i["src"]), 2)
    return each(f["images"], lambda i: ~i["src"].startswith("data:") & (i["alt"].isNull() | (i["alt"] == "")), lambda i: F.when(i["alt"].isNull(), missing(i)).otherwise(empty(i)))


@rule("redirects")
def redirects(f: Column, url: Column, chain: Column) -> Column:
    n = F.size(F.coalesce(chain, F.array().cast("array<string>")))
    return first_of(
        (n > 5, finding("redirects.chain-excessive", "Links", CRITICAL, F.format_string("Redirect chain is %d hops (max 5); excessive redirects hurt crawlability", n), 30)),
        (n > 3, finding("redirects.chain-long", "Links", WARNING, F.format_string("Redirect chain is %d hops (recommended max 3)", n), 15)),
    )


@rule("scripted")
def scripted(f: Column, url: Column, chain: Column) -> Column:
    least = float(os.environ.get("JS_RENDERED_TEXT_RATIO_THRESHOLD", "0.05"))
    tags = int(os.environ.get("JS_RENDERED_MIN_CONTENT_TAGS", "3"))
    likely = (f["html_bytes"] > 0) & (f["text_bytes"] / f["html_bytes"] < least) & (f["content_tags"] < tags)
    return first_of((F.coalesce(likely, F.lit(False)), finding("js-rendered.likely", "Structure", WARNING, "page appears to require JS rendering — results may be incomplete", 10)))


def loop_finding(url: Column, hops: Column) -> Column:
    """What a redirect loop gives in place of a page."""
    return finding("redirects.loop", "Links", CRITICAL, F.concat(F.lit("Redirect loop detected at "), url, F.lit(" after "), hops.cast("string"), F.lit(" hops")), 40)


def page_findings(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add ``findings`` to ``pages`` (url, redirect_chain, facts), in the order of the rules.

    Where a rule meets null facts (no URL, no html) it finds what it finds on an empty page; a null chain
    is an empty one.
    """
    parts = [f(F.col("facts"), F.col("url"), F.col("redirect_chain")) for k, f in RULES.items() if names is None or k in names]
    return pages.withColumn("findings", F.concat(*parts))


def exploded(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding, with ``keys`` and its place among the page's findings."""
    return pages.select(*keys, F.posexplode("findings").alias("finding_no", "f")).select(*keys, "finding_no", "f.*")
