"""Sitemaps: where they are, whether they are well formed, which URLs they name, and the rules on them."""

from __future__ import annotations

import xml.parsers.expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import urls
from auditlake.operators.rules import CRITICAL, WARNING, finding

#: URLs of one sitemap that are checked.
MAX_URLS = 50


def sitemap_url(robots_body: str | None, root: str) -> str | None:
    """The first usable ``Sitemap:`` of robots.txt, absolute or against the root; else /sitemap.xml."""
    base = urls.parsed(root)
    for raw in (robots_body or "").split("\n"):
        name, colon, value = raw.split("#", 1)[0].strip().partition(":")
        if colon and name.strip().lower() == "sitemap" and value.strip():
            found = urls.parse(value.strip()) or (urls.parse(value.strip(), base) if base else None)
            if found:
                return found.text()
    found = urls.parse("/sitemap.xml", base) if base else None
    return found.text() if found else None


def read(body: str | None) -> tuple[bool, list[str]]:
    """(well formed, URLs of <loc>): at most ``MAX_URLS``, none for an index of sitemaps.

    An empty body and bare text are well formed; unclosed or crossed elements are not. Texts that are
    no URL are left out and do not count.
    """
    body = (body or "").strip().lstrip("﻿")
    if not body or "<" not in body:
        return True, []
    found: list[str] = []
    state: dict = {"root": None, "loc": None}
    name = lambda tag: tag.rsplit(":", 1)[-1]
    p = xml.parsers.expat.ParserCreate()

    def start(tag: str, _: dict) -> None:
        state["root"] = state["root"] or name(tag)
        state["loc"] = "" if name(tag) == "loc" else None

    def end(tag: str) -> None:
        if state["loc"] is not None and name(tag) == "loc" and state["root"] != "sitemapindex" and len(found) < MAX_URLS:
            url = urls.parse(state["loc"].strip())
            if url:
                found.append(url.text())
        state["loc"] = None

    def data(text: str) -> None:
        if state["loc"] is not None:
            state["loc"] += text

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, data
    try:
        p.Parse(body, True)
    except xml.parsers.expat.ExpatError:
        return False, []
    return True, found


READ = T.StructType([T.StructField("well_formed", T.BooleanType()), T.StructField("locs", T.ArrayType(T.StringType()))])


@F.pandas_udf(READ)
def read_sitemap(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(b if isinstance(b, str) else None) for b in body], columns=READ.names)


@F.pandas_udf(T.StringType())
def resolve_sitemap(robots_body: pd.Series, root: pd.Series) -> pd.Series:
    return pd.Series([sitemap_url(b if isinstance(b, str) else None, r) if isinstance(r, str) else None for b, r in zip(robots_body, root, strict=True)], dtype=object)


def sitemap_findings(status: Column, sitemap: Column, unreachable: Column | None = None) -> Column:
    """Findings on one sitemap; ``unreachable``: array of (url, status) of its URLs that failed."""
    absent = F.coalesce(~status.between(200, 299), F.lit(True))
    missing = F.array(finding("sitemap.missing", "Crawlability", WARNING, "sitemap.xml not found or inaccessible", 5))
    broken = F.array(finding("sitemap.malformed", "Crawlability", CRITICAL, "sitemap.xml is present but could not be parsed as valid XML", 20))
    none = F.array().cast(missing_type())
    dead = none if unreachable is None else F.coalesce(F.transform(unreachable, lambda u: finding("sitemap.url-unreachable", "Crawlability", WARNING, F.concat(F.lit("Sitemap URL "), u["url"], F.lit(" unreachable (status "), u["status"].cast("string"), F.lit(")")), 5)), none)
    return F.when(absent, missing).when(~sitemap["well_formed"], broken).otherwise(dead)


def missing_type() -> str:
    from auditlake.operators.rules import FINDING

    return f"array<{FINDING}>"


def unreachable_urls(sitemaps: DataFrame, probes: DataFrame, key: str = "host") -> DataFrame:
    """(key, unreachable): URLs of each sitemap whose probe gave no status from 200 to 399 (0: failed)."""
    each = sitemaps.select(key, F.explode("sitemap.locs").alias("url")).distinct()
    joined = each.join(probes.select("url", "status"), "url", "left").withColumn("status", F.coalesce("status", F.lit(0)))
    return joined.where(~F.col("status").between(200, 399)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("url", "status"))).alias("unreachable"))
