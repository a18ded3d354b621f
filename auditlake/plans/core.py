"""Queries for the audit operators over the provided tables, with SQL counterparts.

Rule queries extract facts from ``page.html`` in one Arrow pass; their SQL twins read the same facts with
regular expressions. Scores come from ``finding`` rows, comparisons from ``page_report`` jobs, history
from ``audit_runs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.functions.html_facts import extract
from auditlake.operators import diff, frontier, history, links, report, robots, rules, score, sitemap
from auditlake.plans import audit, problems
from auditlake.session import materialize, shared_dir
from auditlake.sources import recorded
from auditlake.sources.tables import first_copies, spread, table
from auditlake.streaming import limits, progress

KEYS = ["page_id", "url", "redirect_chain"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, redirect_chain, facts) of every capture."""
    return extract(spread(table(spark, sf_dir, "page").select(*KEYS, "html")), KEYS)


def _rule_rows(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    found = rules.page_findings(facts(spark, sf_dir), list(names) or None)
    return rules.exploded(found, ["page_id"]).select("page_id", "check_id", "category", "severity", "penalty")


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    n = lambda c: F.size(f"facts.{c}")
    return f.select("page_id", n("headings").alias("n_headings"), n("images").alias("n_images"), n("links").alias("n_links"), n("canonicals").alias("n_canonicals"), F.col("facts.html_bytes").alias("html_bytes"))


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every page rule, with its message."""
    return rules.exploded(rules.page_findings(facts(spark, sf_dir)), ["page_id"])


def rule_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, check_id, message) of the rules whose messages need no parsed URL."""
    found = rules.page_findings(facts(spark, sf_dir), ["title", "description", "headings", "social", "redirects", "scripted", "https"])
    return rules.exploded(found, ["page_id"]).select("page_id", "check_id", "message")


def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(spark, sf_dir, "title")


def description_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(spark, sf_dir, "description")


def heading_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(spark, sf_dir, "headings")


def social_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(spark, sf_dir, "social")


def image_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(spark, sf_dir, "images")


def https_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(spark, sf_dir, "https")


def redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(spark, sf_dir, "redirects")


def canonical_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(spark, sf_dir, "canonical", "canonicals")


def scripted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(spark, sf_dir, "scripted")


def audited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, score and the seven category scores) from the page's own findings: flagship."""
    scored = score.with_scores(rules.page_findings(facts(spark, sf_dir)))
    return scored.select("page_id", "url", "score", *[F.try_element_at("category_scores", F.lit(k)).alias(k.lower()) for k, _ in rules.CATEGORIES])


def audit_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the pages of each host as JSON."""
    pages = spread(table(spark, sf_dir, "page").select("host", *KEYS, "html"))
    scored = score.with_scores(rules.page_findings(extract(pages, ["host", *KEYS])))
    return report.to_json(report.assemble(scored.where("url IS NOT NULL AND host IS NOT NULL"), "host"))


# --- links -----------------------------------------------------------------------------------


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, target, kind): normalised internal and external links of each page."""
    f = facts(spark, sf_dir).select("page_id", "url", F.col("facts.links").alias("links"))
    return links.link_rows(urls.with_links(f), "page_id", external=True)


def top_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most linked targets of each host."""
    f = facts(spark, sf_dir).select("page_id", "url", F.col("facts.host").alias("host"), F.col("facts.links").alias("links"))
    rows = links.link_rows(urls.with_links(f.where("host IS NOT NULL")).withColumn("key", F.struct("host", "page_id")), "key")
    return links.top_targets(rows.select(F.col("key.host").alias("host"), "target"), "host", 10)


def probe_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on links, probed against a recording in which the URL's MD5 decides how a target answers."""
    rows = page_links(spark, sf_dir)
    targets = rows.select("target").distinct()
    d = F.conv(F.substring(F.md5("target"), 1, 2), 16, 10).cast("int")
    head = F.when(d < 160, 200).when(d < 190, 404).when(d < 210, 500).when(d < 230, 405).cast("int")
    made = lambda method, status, error: targets.select(F.lit(method).alias("method"), F.col("target").alias("url"), status.alias("status"), error.alias("error"), F.lit(0).alias("attempt"))
    responses = made("HEAD", head, F.when(head.isNull(), F.lit("timeout"))).unionByName(made("GET", F.when(d < 245, 200).cast("int"), F.when(d >= 245, F.lit("timeout"))))
    return links.link_findings(rows, links.probe(rows, responses), "page_id").groupBy("check_id", "severity", "penalty").agg(F.count("*").alias("n"))


def url_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of each page's URL, from built-in functions alone."""
    return table(spark, sf_dir, "page").select("page_id", urls.simple_normalise(F.col("url")).alias("normal"))


def same_host_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each report's URL lies on the host that its row names."""
    p = urls.url_parts(F.col("url"))
    return first_copies(table(spark, sf_dir, "page_report").select("report_id", "host", "url"), "report_id").select("report_id", F.coalesce(F.concat(p["host"], F.when(p["port"].isNotNull(), F.concat(F.lit(":"), p["port"])).otherwise("")) == F.col("host"), F.lit(False)).alias("on_host"))


# --- scores ----------------------------------------------------------------------------------


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_copies(table(spark, sf_dir, "page_report").drop("received_at", "category_scores"), "report_id")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_copies(table(spark, sf_dir, "finding").select("finding_id", "report_id", "category", "severity", "penalty"), "finding_id")


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven category scores of each report, from its findings."""
    return score.scores_from_rows(table(spark, sf_dir, "page_report").select("report_id"), _findings(spark, sf_dir), "report_id")


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.page_score_from_rows(category_scores(spark, sf_dir), "report_id")


def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated mean page score of each host."""
    return score.site_scores(_reports(spark, sf_dir).where("host IS NOT NULL"), "host")


def _category_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = first_copies(table(spark, sf_dir, "page_report").select("report_id", "job_id", "host", "reported_at", F.map_entries("category_scores").alias("c")), "report_id")
    return r.select("report_id", "job_id", "host", F.explode("c").alias("c")).select("report_id", "job_id", "host", F.col("c.key").alias("category"), F.col("c.value").alias("score"))


def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each category by host, with the length of its bar."""
    return score.category_means(_category_rows(spark, sf_dir).where("host IS NOT NULL"), "host")


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.severity_counts(_findings(spark, sf_dir), "report_id")


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).where("score IS NOT NULL").groupBy(score.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


# --- comparison and history ------------------------------------------------------------------


def _last_jobs(reports: DataFrame) -> DataFrame:
    """(host, job_id, place) of the last two jobs of each host, the last first."""
    from pyspark.sql import Window

    jobs = reports.where("host IS NOT NULL AND job_id IS NOT NULL").groupBy("host", "job_id").agg(F.max("reported_at").alias("at"))
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("at"), F.desc("job_id")))).where("place <= 2").select("host", "job_id", "place")


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages (host, url, score) of the last job of each host and of the one before."""
    r = _reports(spark, sf_dir).where("host IS NOT NULL AND job_id IS NOT NULL")
    ranked = _last_jobs(r)
    rows = materialize(r.join(ranked, ["host", "job_id"]).select("host", "url", "score", "place", F.struct("reported_at", "report_id").alias("pos")), "jobs")
    side = lambda k: diff.last_entries(rows.where(F.col("place") == k), ["host", "url"], "pos", ["score"])
    return side(2), side(1)


def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's last two jobs compared page by page."""
    return diff.page_diff(*_jobs(spark, sf_dir), ["host", "url"])


def report_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.summary(report_diff(spark, sf_dir), ["host"])


def job_category_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each category's mean from the last job but one of a host to its last."""
    rows = _category_rows(spark, sf_dir).where("host IS NOT NULL AND job_id IS NOT NULL")
    placed = materialize(rows.join(_last_jobs(_reports(spark, sf_dir)), ["host", "job_id"]).select("host", "category", "score", "place"), "categories")
    return diff.category_deltas(placed.where("place = 2"), placed.where("place = 1"), ["host"])


def report_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page comparison as a terminal shows it: short URL, signed delta."""
    return report_diff(spark, sf_dir).select("host", diff.short(F.col("url")).alias("page"), "kind", diff.signed(F.col("delta")).alias("change"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct runs with evenly written hosts."""
    return problems.host_runs(spark, sf_dir).withColumnsRenamed({"score": "site_score", "at": "crawled_at"})


def history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest runs of each host."""
    runs = _history(spark, sf_dir)
    return history.newest_per_host(runs, 3).select("host", "id", "site_score", "place")


def score_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _history(spark, sf_dir)
    return history.regressions(runs, 5)


def history_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _history(spark, sf_dir)
    c = history.chart(runs)
    return c.select("host", "id", "site_score", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# --- crawl -----------------------------------------------------------------------------------


def _link_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Seeds (a job per host, from its home page or least URL) and the edges that pages draw."""
    f = facts(spark, sf_dir).select("page_id", "url", F.col("facts.host").alias("host"), F.col("facts.links").alias("links"))
    pages = materialize(urls.with_links(f.where("host IS NOT NULL")).select("page_id", "url", "host", "discovered"), "graph")
    seeds = pages.groupBy(F.col("host").alias("job_id")).agg(F.min("url").alias("url"))
    return seeds, pages.select(F.col("url").alias("src"), F.posexplode("discovered").alias("pos", "dst"))


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, url, depth) of what three levels of links reach from each host's first URL."""
    return frontier.crawl(*_link_graph(spark, sf_dir), max_depth=3).select("job_id", "url", "depth")


def crawl_max_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with at most five pages a job, in order of discovery."""
    return frontier.crawl(*_link_graph(spark, sf_dir), max_depth=3, max_pages=5)


def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the redirects seen in captures lead: each hop of a chain is an edge."""
    p = table(spark, sf_dir, "page").select("url", F.col("redirect_chain").alias("c")).where("size(c) > 0 AND url IS NOT NULL")
    full = F.concat("c", F.array("url"))
    hops = p.select(F.explode(F.arrays_zip(F.slice(full, 1, F.size("c")).alias("src"), F.slice(full, 2, F.size("c")).alias("dst"))).alias("h")).select("h.src", "h.dst").where("src <> dst")
    hops = materialize(hops, "hops")
    return frontier.resolve_redirects(hops.select(F.col("src").alias("url")), hops).select("url", "final", F.size("chain").alias("n_hops"), "is_loop")


# --- robots, sitemaps, charsets: bodies made from the hosts of the data ----------------------

# Robots.txt bodies that exercise the parser's rules, chosen by the length of the host.
ROBOTS = (
    "User-agent: *\nDisallow: /legal\nAllow: /legal/public\nCrawl-delay: 2\n\nSitemap: https://x.example/map.xml",
    "User-agent: *\n# note\nDisallow: /\n",
    "User-agent: a\nDisallow: /shop\nUser-agent: Auditlake\nDisallow: /news\nAllow: /news/2024\n\nUser-agent: *\nDisallow: /",
    "USER-AGENT: *\nDISALLOW: /\nSitemap: /map.xml",
)


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "page").select("host").where("host IS NOT NULL").distinct()
    bodies = F.array(*[F.lit(b) for b in ROBOTS])
    return hosts.withColumn("body", F.element_at(bodies, (F.pmod(F.length("host"), F.lit(len(ROBOTS))) + 1).cast("int")))


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each host by the window-function parser."""
    return robots.rule_rows(_robots(spark, sf_dir))


def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which captures' paths the rules of their host allow."""
    parsed = _robots(spark, sf_dir).select("host", F.explode(robots.parse_robots("body")["rules"]).alias("r")).select("host", "r.*")
    paths = table(spark, sf_dir, "page").select("page_id", "host", F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1).alias("path"))
    return robots.decisions(paths, parsed, "auditlake/0.1").select("page_id", "allowed")


def robots_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _robots(spark, sf_dir).select("host", F.lit(200).alias("status"), robots.parse_robots("body").alias("robots"))
    return parsed.select("host", F.explode(robots.robots_findings(F.col("status"), F.col("robots"))).alias("f")).select("host", "f.check_id", "f.severity", "f.penalty")


def crawl_delay_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _robots(spark, sf_dir).select("host", robots.parse_robots("body").alias("robots"))
    return robots.crawl_delays(parsed)


def sitemap_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that a sitemap of each host's captures names, at most fifty."""
    pages = table(spark, sf_dir, "page").where("host IS NOT NULL AND url IS NOT NULL").select("host", "url").distinct()
    loc = F.concat(F.lit("<url><loc> "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    body = pages.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", loc.alias("l")))), lambda x: x["l"]), "").alias("b"))
    full = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "b", F.lit("</urlset>"))
    return body.select("host", F.posexplode(sitemap.read_sitemap(full)["locs"]).alias("pos", "loc"))


def _lot(c: str):
    """A number from 0 to 255 that decides how a recorded host or URL behaves."""
    return F.conv(F.substring(F.md5(c), 1, 2), 16, 10).cast("int")


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page").select("host").where("host IS NOT NULL").distinct().withColumn("d", _lot("host"))


def robots_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on each host's robots.txt where half of the hosts have none."""
    parsed = _robots(spark, sf_dir).select("host", F.when(_lot("host") < 128, 404).otherwise(200).alias("status"), robots.parse_robots("body").alias("robots"))
    return parsed.select("host", F.explode(robots.robots_findings(F.col("status"), F.col("robots"))).alias("f")).select("host", "f.check_id", "f.message")


def sitemap_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on each host's recorded sitemap: absent, malformed, with a dead URL, or sound."""
    d, at = F.col("d"), lambda path: F.concat(F.lit("<url><loc>https://"), "host", F.lit(path + "</loc></url>"))
    body = F.when(d < 100, F.lit("<urlset><url>")).otherwise(F.concat(F.lit("<urlset>"), at("/ok"), F.when(d < 190, at("/dead")).otherwise(F.lit("")), F.lit("</urlset>")))
    site = _hosts(spark, sf_dir).select("host", F.when(d < 50, 404).otherwise(200).alias("status"), sitemap.read_sitemap(body).alias("sitemap"))
    locs = site.select(F.explode("sitemap.locs").alias("url"))
    dead = sitemap.unreachable_urls(site, locs.select("url", F.when(F.endswith("url", F.lit("/dead")), 404).otherwise(200).alias("status")))
    found = site.join(dead, "host", "left").select("host", F.explode(sitemap.sitemap_findings(F.col("status"), F.col("sitemap"), F.col("unreachable"))).alias("f"))
    return found.select("host", "f.check_id", "f.message")


def redirect_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fetching /0 of each host gives where some hosts redirect in a circle or too often."""
    hosts = _hosts(spark, sf_dir)
    last = F.when(F.col("d") < 85, 1).when(F.col("d") < 170, 3).otherwise(12)
    hop = hosts.withColumn("n", last).select("host", "d", "n", F.explode(F.sequence(F.lit(0), "n")).alias("i"))
    at = lambda i: F.concat(F.lit("https://"), "host", F.lit("/"), i.cast("string"))
    to = F.when(F.col("i") < F.col("n"), at(F.col("i") + 1)).when(F.col("d") < 85, at(F.lit(0)))
    made = hop.select(F.lit("GET").alias("method"), at(F.col("i")).alias("url"), F.when(to.isNotNull(), 301).otherwise(200).alias("status"), to.alias("location"), F.create_map().cast("map<string,string>").alias("headers"), F.lit(None).cast("binary").alias("body"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempt"))
    got = recorded.fetch(hosts.select("host", at(F.lit(0)).alias("requested")), materialize(made, "loops"))
    looped = F.col("error") == "RedirectLoop"
    return got.select("host", F.size("redirect_chain").alias("n_hops"), "error", F.when(looped, rules.loop_finding(F.col("requested"), F.size("redirect_chain"))["message"]).alias("message"))


def retried_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that counts for each page URL where some servers answer 429 or 503 first, and the wait before a next try."""
    pages = table(spark, sf_dir, "page").select("url").where("url IS NOT NULL").distinct().withColumn("d", _lot("url"))
    tries = pages.select("url", "d", F.explode(F.sequence(F.lit(0), F.when(F.col("d") < 85, 1).when(F.col("d") < 170, 3).otherwise(0))).alias("attempt"))
    status = F.when(F.col("d") < 85, F.when(F.col("attempt") == 0, 429).otherwise(200)).when(F.col("d") < 170, 503).otherwise(200)
    made = tries.select(F.lit("GET").alias("method"), "url", status.alias("status"), F.lit(None).cast("string").alias("error"), "attempt", F.when(F.col("d") < 40, "7").alias("retry_after"))
    return recorded.final_attempts(made).select("url", "status", "attempt", recorded.retry_wait(F.col("retry_after"), F.col("attempt")).alias("wait"))


def decoded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in two charsets, named by the header or by the body itself, decoded again."""
    d, text = _lot("url"), F.concat(F.lit("naïve "), "url")
    meta = F.concat(F.lit('<meta charset="iso-8859-1">'), text)
    body = F.when(d < 85, F.encode(text, "ISO-8859-1")).when(d < 170, F.encode(meta, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    label = F.when(d < 85, "text/html; charset=ISO-8859-1").when(d < 170, "text/html").otherwise("text/html; charset=unheard-of")
    return table(spark, sf_dir, "page").where(F.rlike("url", F.lit("^[ -~]*$"))).select("page_id", recorded.decode_html(body, label).alias("text"))


def charset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charset that each capture's headers declare, in lower case."""
    label = F.lower(F.regexp_extract(F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit("")), r"(?i)charset=\s*[\"']?([^\s;\"']+)", 1))
    return table(spark, sf_dir, "page").select("page_id", F.nullif(label, F.lit("")).alias("charset"))


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures replayed as recorded responses: redirects followed, bodies decoded."""
    p = table(spark, sf_dir, "page").where("url IS NOT NULL").groupBy("url").agg(F.min_by(F.struct("redirect_chain", "status", "html", "headers"), "page_id").alias("r")).select("url", "r.*")
    full = F.concat(F.coalesce("redirect_chain", F.array().cast("array<string>")), F.array("url"))
    seeds = p.select("url", F.element_at(full, 1).alias("requested"))
    hop = p.select(F.posexplode(full).alias("i", "at"), full.alias("full"), "status", "html", "headers")
    last = F.col("i") == F.size("full") - 1
    made = hop.select(
        F.lit("GET").alias("method"),
        F.col("at").alias("url"),
        F.when(last, F.coalesce("status", F.lit(200))).otherwise(301).alias("status"),
        F.when(~last, F.try_element_at("full", F.col("i") + 2)).alias("location"),
        F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8")).alias("headers"),
        F.when(last, F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("body"),
        F.lit(None).cast("string").alias("error"),
        F.lit(0).alias("attempt"),
    )
    made = made.groupBy("method", "url").agg(F.min_by(F.struct(*[c for c in made.columns if c not in ("method", "url")]), F.struct("status", "location")).alias("r")).select("method", "url", "r.*")
    got = recorded.fetch(seeds.select("requested").distinct(), made)
    return got.select("requested", "url", "status", F.size("redirect_chain").alias("n_hops"), F.length("html").alias("n_chars"), "error")


def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of depth 1 from each host's first capture over the captures as a recorded web."""
    p = table(spark, sf_dir, "page").where("url IS NOT NULL AND html IS NOT NULL AND coalesce(status, 200) BETWEEN 200 AND 299").groupBy("url").agg(F.min_by(F.struct("host", "html"), "page_id").alias("r")).select("url", "r.*")
    web = p.select(F.lit("GET").alias("method"), "url", F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"), F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8")).alias("headers"), F.encode("html", "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempt"))
    files = _robots(spark, sf_dir).select(F.lit("GET").alias("method"), F.concat(F.lit("https://"), "host", F.lit("/robots.txt")).alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"), F.create_map().cast("map<string,string>").alias("headers"), F.encode("body", "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempt"))
    seeds = p.where("host IS NOT NULL").groupBy(F.col("host").alias("job_id")).agg(F.min("url").alias("url"))
    out = audit.audit(seeds, materialize(web.unionByName(files), "web"), audit.Config(depth=1, user_agent="auditlake"))
    return out.select("job_id", "url", "depth", F.size("findings").alias("n_findings"), "score")


# --- streams and limits ----------------------------------------------------------------------


def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages done and mean score of each job, counted by a streaming query over all reports."""
    import uuid

    like = table(spark, sf_dir, "page_report")
    where = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    stream = progress.read_stream(spark, f"{sf_dir}/page_report.parquet", like)
    progress.run_to_table(progress.job_counts(stream), f"{where}/table", f"{where}/state")
    return spark.read.parquet(progress.newest_version(spark, f"{where}/table"))


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events admitted by fixed windows of a day per user, five each."""
    return limits.fixed_windows(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", 86400, 5)


def grant_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a bucket of two requests a second with a spacing of one second would let each fetch go."""
    p = table(spark, sf_dir, "page").where("host IS NOT NULL AND fetched_at IS NOT NULL").select("page_id", "host", (F.unix_micros(F.col("fetched_at").cast("timestamp")) / 1e6).alias("t"))
    out = limits.grant_times(p, "host", "t", 2.0, 1.0, "page_id")
    return out.select("page_id", F.round("granted", 3).alias("granted"))


QUERIES = {
    f.__name__: f
    for f in (
        audited_pages, page_facts, page_findings, rule_messages, title_rules, description_rules, heading_rules, social_rules, image_rules, https_rules, redirect_rules, canonical_rules, scripted_rules, audit_report_json,
        page_links, top_linked, probe_classes, url_normal_forms, same_host_urls,
        category_scores, page_scores, site_scores, category_means, severity_counts, score_bands,
        report_diff, report_diff_summary, report_diff_lines, job_category_deltas, history_topk, score_regressions, history_chart,
        crawl_bfs, crawl_max_pages, redirect_targets, robots_rules, robots_decisions, robots_findings, crawl_delay_by_host, robots_states, sitemap_locs, sitemap_rules, redirect_loops, retried_responses, decoded_bodies, charset_labels, fetched_pages, full_audit,
        progress_stream, rate_limit_windows, grant_times,
    )
}
