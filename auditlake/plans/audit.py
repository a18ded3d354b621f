"""The whole audit on recorded responses: crawl, fetch, extract, rules, scores, reports."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.functions.html_facts import extract
from auditlake.operators import links as link_ops
from auditlake.operators import robots as robots_ops
from auditlake.operators import rules, score, sitemap
from auditlake.session import materialize
from auditlake.sources import recorded


@dataclass
class Config:
    """Options of an audit; a rate of 0 counts as 1."""

    depth: int = 1
    rate: float = 2
    max_pages: int | None = None
    timeout: float = 30
    global_timeout: float | None = None
    user_agent: str = "auditlake"
    ignore_robots: bool = False
    validate_sitemap: bool = False
    check_external_links: bool = False
    concurrency: int | None = None

    def __post_init__(self) -> None:
        self.rate = self.rate or 1


def origin_of(url):
    """scheme://host[:port] of an absolute URL."""
    p = urls.url_parts(url)
    return F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"].isNotNull(), F.concat(F.lit(":"), p["port"])).otherwise(""))


def host_files(pages: DataFrame, responses, name: str, url_column: str = "url") -> DataFrame:
    """(origin, status, body) of ``/name`` of each origin of ``pages``: fetched once per origin."""
    origins = pages.select(origin_of(F.col(url_column)).alias("origin")).where("origin IS NOT NULL").distinct()
    got = recorded.fetch(origins.withColumn("requested", F.concat("origin", F.lit("/" + name))), responses)
    return got.select("origin", F.when(F.col("error").isNull(), F.col("status")).alias("status"), F.col("html").alias("body"))


def fetch_level(frontier: DataFrame, responses, config: Config) -> DataFrame:
    """Pages of one level (requested, depth, ...) that robots.txt allows and that could be fetched, at its crawl delay."""
    if not config.ignore_robots:
        files = host_files(frontier, responses, "robots.txt", "requested").where("status BETWEEN 200 AND 299")
        robots = materialize(files.select("origin", robots_ops.parse_robots("body").alias("robots")), "robots")
        parsed = robots.select("origin", F.explode("robots.rules").alias("r")).select("origin", "r.*")
        paths = frontier.withColumn("origin", origin_of(F.col("requested"))).withColumn("path", urls.url_parts(F.col("requested"))["path"])
        frontier = robots_ops.decisions(paths, parsed, config.user_agent, "origin").where("allowed").drop("allowed", "path")
        frontier = frontier.join(robots_ops.crawl_delays(robots, "origin"), "origin", "left").drop("origin")
        return recorded.fetch(frontier, responses).drop("delay")
    return recorded.fetch(frontier, responses)


def site_findings(pages: DataFrame, responses, config: Config) -> DataFrame:
    """Add the findings on robots.txt, sitemap and links to ``pages`` (page_key, url, links, findings).

    Each host file and each link target is fetched once; the findings then go to every page they concern.
    """
    robots = host_files(pages, responses, "robots.txt")
    parsed = robots.withColumn("robots", robots_ops.parse_robots("body"))
    maps = parsed.withColumn("requested", sitemap.resolve_sitemap(F.when(F.col("status").between(200, 299), F.col("body")), F.concat("origin", F.lit("/")))).select("origin", "requested")
    got = recorded.fetch(maps.where("requested IS NOT NULL"), responses)
    site = got.select("origin", F.when(F.col("error").isNull(), F.col("status")).alias("status"), sitemap.read_sitemap("html").alias("sitemap"))
    dead = None
    if config.validate_sitemap:
        probes = link_ops.probe(site.select(F.explode("sitemap.locs").alias("target")), responses).withColumnRenamed("target", "url")
        site = site.join(sitemap.unreachable_urls(site, probes, "origin"), "origin", "left")
        dead = F.col("unreachable")
    per_origin = parsed.select("origin", robots_ops.robots_findings(F.col("status"), F.col("robots")).alias("rf")).join(site.select("origin", sitemap.sitemap_findings(F.col("status"), F.col("sitemap"), dead).alias("sf")), "origin", "left")
    rows = link_ops.link_rows(pages.select("page_key", "internal", "external"), "page_key", config.check_external_links)
    broken = link_ops.link_findings(rows, link_ops.probe(rows, responses), "page_key")
    entry = F.struct("check_id", "category", "severity", "message", "penalty")
    per_page = broken.groupBy("page_key").agg(F.array_sort(F.collect_list(entry)).alias("lf"))
    empty = F.array().cast(f"array<{rules.FINDING}>")
    joined = pages.withColumn("origin", origin_of(F.col("url"))).join(per_origin, "origin", "left").join(per_page, "page_key", "left")
    every = F.concat("findings", *[F.coalesce(c, empty) for c in ("rf", "sf", "lf")])
    return joined.withColumn("findings", every).drop("origin", "rf", "sf", "lf")


#: Pages of a level that are audited in one step where someone watches the progress.
STEP = 16


def _steps(level: DataFrame, watched: bool) -> list[DataFrame]:
    """The level whole or, if it is watched, in steps in the order of its pages."""
    if not watched:
        return [level]
    first, last = level.agg(F.min("place"), F.max("place")).collect()[0]
    return [level.where(F.col("place").between(p, p + STEP - 1)) for p in range(first or 0, (last or -1) + 1, STEP)]


def _audit_pages(level: DataFrame, responses, config: Config) -> tuple[DataFrame, DataFrame]:
    """(job_id, root, url, depth, findings) of the pages of one step, and the pages with their links."""
    single = config.depth == 0
    fetched = materialize(fetch_level(level, responses, config), "fetched")
    facts = extract(fetched.where("error IS NULL"), ["job_id", "root", "requested", "url", "depth", "place", "redirect_chain"])
    found = rules.page_findings(facts).withColumn("links", F.col("facts.links")).withColumn("base", F.col("url" if single else "requested"))
    linked = materialize(urls.with_links(found.drop("facts"), "base", "links"), "level")
    pages = linked.withColumn("page_key", F.concat_ws("\n", "job_id", "requested"))
    scored = site_findings(pages, responses, config).select("job_id", "root", F.col("base").alias("url"), "depth", "findings")
    if single:
        loops = fetched.where("error = 'RedirectLoop'")
        scored = scored.unionByName(loops.select("job_id", "root", F.col("requested").alias("url"), "depth", F.array(rules.loop_finding(F.col("requested"), F.size("redirect_chain"))).alias("findings")))
    return scored, linked


def audit(seeds: DataFrame, responses, config: Config | None = None, on_pages: Callable[[list, int], None] | None = None) -> DataFrame:
    """(job_id, root, url, depth, findings, category_scores, score) of each page of each job.

    ``responses``: recorded responses or a ``Web``. ``seeds``: job_id, url. Depth 0 audits the root alone; a page is reported under its final URL then,
    under the requested URL in a crawl. Rules see the final URL, links are taken against the requested
    one. Pages that are not allowed or could not be fetched have no report, but for a redirect loop of a
    root at depth 0. The global timeout is checked between steps, and a ``Web`` with a deadline asks nothing
    after it; what was finished stands. ``on_pages`` gets the (url, score) rows of each step and the number of URLs known.
    """
    config = config or Config()
    began = time.monotonic()
    level = seeds.where("url IS NOT NULL").select("job_id", F.col("url").alias("root"), F.col("url").alias("requested")).distinct().withColumn("depth", F.lit(0)).withColumn("place", F.lit(1).cast("bigint"))
    seen = level.select("job_id", "requested", "place")
    out = None
    late = lambda: config.global_timeout is not None and time.monotonic() - began > config.global_timeout
    for depth in range(config.depth + 1):
        children = None
        for step in _steps(level, on_pages is not None):
            scored, linked = _audit_pages(step, responses, config)
            if on_pages is not None:
                scored = materialize(scored, "scored")
                on_pages(score.with_scores(scored).select("url", "score").collect(), seen.count())  # a step has few pages
            out = scored if out is None else out.unionByName(scored)
            found = linked.select("job_id", "root", "place", F.posexplode("discovered").alias("pos", "child"))
            children = found if children is None else children.unionByName(found)
            if late():
                break
        if depth == config.depth or late() or children is None:
            break
        level, seen = _next_level(children, seen, depth + 1, config.max_pages, on_pages is not None)
        if level.isEmpty():
            break
    return score.with_scores(out)


def _next_level(children: DataFrame, seen: DataFrame, depth: int, max_pages: int | None, ordered: bool) -> tuple[DataFrame, DataFrame]:
    """New URLs in the order of (place of the parent, place of the link), within the page budget."""
    from pyspark.sql import Window

    fresh = children.groupBy("job_id", F.col("child").alias("requested")).agg(F.min("root").alias("root"), F.min(F.struct("place", "pos")).alias("first"))
    fresh = fresh.join(seen.select("job_id", "requested"), ["job_id", "requested"], "left_anti")
    used = seen.groupBy("job_id").agg(F.max("place").alias("used"))
    order = Window.partitionBy("job_id").orderBy("first.place", "first.pos", "requested")
    if max_pages is None and not ordered:
        new = fresh.withColumn("place", F.lit(1).cast("bigint"))  # the order decides nothing then
    else:
        ranked = fresh.withColumn("r", F.row_number().over(order))
        if max_pages is not None:  # each task keeps a job's first rows before the shuffle, as no more can count
            ranked = ranked.where(F.col("r") <= max(1, max_pages))
        new = ranked.join(used, "job_id").withColumn("place", F.col("used") + F.col("r"))
        if max_pages is not None:
            new = new.where(F.col("place") <= max_pages)
    level = materialize(new.select("job_id", "root", "requested", F.lit(depth).alias("depth"), "place"), "frontier")
    return level, seen.unionByName(level.select("job_id", "requested", "place"))
