"""Links of pages, their probes, and the rules on broken ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.rules import CRITICAL, WARNING, finding
from auditlake.sources.web import as_web


def link_rows(pages: DataFrame, key: str, external: bool = False) -> DataFrame:
    """(key, target, kind) of the links to probe: internal ones and, if asked, external ones.

    ``pages`` has the columns of ``urls.with_links``. Links of one page do not repeat.
    """
    tag = lambda c, k: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda u: F.struct(u.alias("target"), F.lit(k).alias("kind")))
    both = tag(F.col("internal"), "internal")
    if external:
        both = F.concat(both, tag(F.col("external"), "external"))
    return pages.select(key, F.explode(both).alias("l")).select(key, "l.*")


def probe(targets: DataFrame, source) -> DataFrame:
    """(target, status) of each distinct target in ``source``: recorded responses (method, url, status, error)
    or a ``Web``.

    HEAD first; on 405 or a failed HEAD, GET counts; a failed GET is status 0. A target without a record
    failed. The later of two attempts counts. Each target is probed once, however many pages link to it.
    """
    wanted = targets.select("target").where(F.col("target").isNotNull()).distinct()
    web = as_web(source)
    answer = F.max(F.struct(F.coalesce("attempt", F.lit(0)).alias("attempt"), F.when(F.col("error").isNull(), F.col("status")).alias("status")))["status"]
    ask = lambda urls, method: web(urls.select(F.col("target").alias("url")), method).groupBy(F.col("url").alias("target")).agg(answer.alias(method.lower()))
    first = wanted.join(ask(wanted, "HEAD"), "target", "left")
    again = F.col("head").isNull() | (F.col("head") == 405)
    both = first.join(ask(first.where(again), "GET"), "target", "left")
    return both.select("target", F.when(again, F.coalesce("get", F.lit(0))).otherwise(F.col("head")).alias("status"))


def status_class(status: Column) -> Column:
    """ok (200-399), broken-4xx, broken-5xx or unreachable."""
    return F.when(status.between(400, 499), "broken-4xx").when(status.between(500, 599), "broken-5xx").when(status.between(200, 399), "ok").otherwise("unreachable")


def link_finding(status: Column, target: Column) -> Column:
    """Finding on one link, null if it works."""
    code = status.cast("string")
    return (
        F.when(status.between(400, 499), finding("links.broken-4xx", "Links", WARNING, F.concat(F.lit("Broken link (HTTP "), code, F.lit("): "), target), 10))
        .when(status.between(500, 599), finding("links.broken-5xx", "Links", CRITICAL, F.concat(F.lit("Server error link (HTTP "), code, F.lit("): "), target), 20))
        .when(~status.between(200, 399), finding("links.unreachable", "Links", WARNING, F.concat(F.lit("Unreachable link: "), target), 10))
    )


def link_findings(links: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """(key, finding columns) of each broken link of each page."""
    joined = links.join(probes, "target")
    return joined.select(key, link_finding(F.col("status"), F.col("target")).alias("f")).where("f IS NOT NULL").select(key, "f.*")


def top_targets(links: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most linked targets of each ``key``: (key, target, n_links, place).

    Counts are combined before the shuffle; the window sees one row per target and keeps only the
    first ranks of each task, so a group of any size is cut before it is sorted as a whole.
    """
    from pyspark.sql import Window

    counts = links.groupBy(key, "target").agg(F.count("*").alias("n_links"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_links"), "target")))
    return ranked.where(F.col("place") <= n)
