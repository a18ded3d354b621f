"""Queries of the general data problems: nested records, skewed keys, changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.balance import Plan, balanced_join, per_key, plan_load
from auditlake.operators.neighbours import with_neighbours
from auditlake.operators.nested import decode_reports, flat_table, flatten_reports, report_items
from auditlake.operators.snapshots import history_changes
from auditlake.session import materialize
from auditlake.sources.tables import first_copies, spread, table

#: A key is heavy from this share of all distinct rows.
HEAVY_SHARE = 0.03


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_copies(table(spark, sf_dir, "audit_runs", locate=True), "id")


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_reports(spread(_runs(spark, sf_dir).select(F.col("id").alias("run_id"), "report")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, page_no, kind, item): every child of every readable report."""
    return report_items(_decoded(spark, sf_dir))


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run id, readable or not."""
    return flatten_reports(_runs(spark, sf_dir))["runs"]


def p4_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, readable, n_pages) of every run."""
    return p4_runs(spark, sf_dir).select("run_id", "readable", "n_pages")


def p4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_decoded(spark, sf_dir), "pages")


def p4_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_decoded(spark, sf_dir), "findings")


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_decoded(spark, sf_dir), "scores")


# --- per-key results without imbalance -------------------------------------------------------


def host_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, host, score, at): distinct runs, host trimmed and in lower case, blank as null."""
    host = F.lower(F.regexp_replace("host", r"^\s+|\s+$", ""))
    runs = table(spark, sf_dir, "audit_runs").select("id", host.alias("host"), F.col("site_score").alias("score"), F.col("crawled_at").alias("at"))
    return first_copies(runs.withColumn("host", F.when(F.col("host") != "", F.col("host"))), "id")


def url_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url, score, at): distinct page reports."""
    reports = table(spark, sf_dir, "page_report").select(F.col("report_id").alias("id"), "url", "score", F.col("reported_at").alias("at"))
    return first_copies(reports, "id")


def _keyed(rows: DataFrame, key: str) -> tuple[DataFrame, Plan]:
    kept = materialize(rows, f"keys-{key}")
    plan = plan_load(kept, key)
    return per_key(kept, key, "id", "score", "at", plan), plan


def p5_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(host_runs(spark, sf_dir), "host")[0]


def p5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(url_reports(spark, sf_dir), "url")[0]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_kind, key_value): keys that hold at least 3 % of all distinct rows."""
    out = None
    for kind, rows in (("host", host_runs(spark, sf_dir)), ("url", url_reports(spark, sf_dir))):
        result, plan = _keyed(rows, kind)
        heavy = result.where(F.col("n") >= F.lit(HEAVY_SHARE) * F.lit(plan.total)).select(F.lit(kind).alias("key_kind"), F.col(kind).alias("key_value"))
        out = heavy if out is None else out.unionByName(heavy)
    return out


def p5_score_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report with its distance from its URL's mean: a skewed join with replicated fragments."""
    kept = materialize(url_reports(spark, sf_dir), "reports")
    plan = plan_load(kept, "url")
    means = per_key(kept, "url", "id", "score", "at", plan).select("url", "n", "mean_score")
    joined = balanced_join(kept, means, "url", F.col("id"), plan)
    return joined.select(F.col("id").alias("report_id"), "url", "score", "n", F.round(F.col("score") - F.col("mean_score"), 6).alias("gap"))


# --- changes between snapshots ---------------------------------------------------------------


def _changes(spark: SparkSession, sf_dir: str, fetch: bool) -> DataFrame:
    runs = spread(_runs(spark, sf_dir).select(F.col("id").alias("run_id"), "root_url", "crawled_at", "report"))
    slim = decode_reports(runs).withColumn("pages", F.transform("pages", lambda p: F.struct(p["url"].alias("url"), p["score"].alias("score"))))
    readable = materialize(slim, "snapshots").where("pages IS NOT NULL")
    steps = with_neighbours(readable, "root_url", "run_id", ["crawled_at"]).withColumnRenamed("run_id", "snapshot_id")
    rows = readable.select(F.col("run_id").alias("snapshot_id"), F.posexplode("pages").alias("pos", "p")).select("snapshot_id", "pos", F.col("p.url").alias("url"), F.expr("try_cast(p.score AS double)").alias("score"))
    return history_changes(rows, steps, ["url"], ["score"], fetch)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(before_run_id, after_run_id, url, change_kind) between consecutive readable runs of a root."""
    return _changes(spark, sf_dir, False).select(F.col("before_id").alias("before_run_id"), F.col("after_id").alias("after_run_id"), "url", "change_kind")


def p6_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the scores on either side."""
    c = _changes(spark, sf_dir, True)
    return c.select(F.col("before_id").alias("before_run_id"), F.col("after_id").alias("after_run_id"), "url", "change_kind", "before_score", "after_score")


QUERIES = {f.__name__: f for f in (p4_found, p4_runs, p4_readable, p4_pages, p4_findings, p4_scores, p5_found, p5_hosts, p5_urls, p5_score_gaps, p6_found, p6_changes)}

_RUNS = "SELECT DISTINCT id, nullif(lower(trim(host, chr(9) || chr(10) || chr(13) || ' ')), '') AS host, site_score, crawled_at FROM audit_runs"
_REPORTS = "SELECT DISTINCT report_id AS id, url, score, reported_at FROM page_report"


def _per_key(key: str, rows: str, score: str, at: str) -> str:
    return f"""WITH r AS ({rows}), w AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC, id DESC) AS rn FROM r WHERE {key} IS NOT NULL)
SELECT {key}, count(*) AS n, CAST(sum({score}) AS DOUBLE) / count({score}) AS mean_score, max(CASE WHEN rn = 1 THEN {score} END) AS latest_score FROM w GROUP BY {key}"""


_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(65279)"


def _unwrap(source: str, result: str) -> str:
    """One level of string or envelope taken off; the same text if there is none, null if it is no JSON."""
    wrapped = "json_type(r) = 'OBJECT' AND coalesce(json_type(r, '$.pages'), 'NONE') <> 'ARRAY' AND json_type(r, '$.report')"
    return f"""{result} AS (SELECT id, CASE WHEN r IS NULL OR NOT json_valid(r) THEN NULL WHEN json_type(r) = 'VARCHAR' THEN trim(json_extract_string(r, '$'), {_WHITE})
 WHEN {wrapped} = 'OBJECT' THEN CAST(json_extract(r, '$.report') AS VARCHAR) WHEN {wrapped} = 'VARCHAR' THEN trim(json_extract_string(r, '$.report'), {_WHITE}) ELSE r END AS r FROM {source})"""


_READ = f"""a0 AS (SELECT DISTINCT id, trim(report, {_WHITE}) AS r FROM audit_runs), {_unwrap("a0", "a1")}, {_unwrap("a1", "a2")}, {_unwrap("a2", "a3")}, {_unwrap("a3", "a4")},
g AS (SELECT id AS run_id, json_extract(r, '$.pages') AS pages FROM a4 WHERE r IS NOT NULL AND json_valid(r) AND json_type(r) = 'OBJECT' AND json_type(r, '$.pages') = 'ARRAY'),
p AS (SELECT run_id, CAST(i AS INT) AS page_no, json_extract(pages, '$[' || i || ']') AS pg FROM (SELECT run_id, pages, unnest(range(CAST(json_array_length(pages) AS BIGINT))) AS i FROM g)),
o AS (SELECT * FROM p WHERE json_type(pg) = 'OBJECT')"""
_LIST = """f AS (SELECT run_id, page_no, CASE WHEN json_type(pg, '$.findings') = 'OBJECT' THEN json_array(json_extract(pg, '$.findings')) WHEN json_type(pg, '$.findings') = 'ARRAY' THEN json_extract(pg, '$.findings') END AS l FROM o),
fi AS (SELECT run_id, page_no, CAST(i AS INT) AS finding_no, json_extract(l, '$[' || i || ']') AS f FROM (SELECT run_id, page_no, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS i FROM f WHERE l IS NOT NULL)),
s AS (SELECT run_id, page_no, CASE WHEN json_type(pg, '$.category_scores') = 'OBJECT' THEN json_keys(pg, '$.category_scores') WHEN json_type(pg, '$.category_scores') = 'ARRAY' THEN json_extract_string(pg, '$.category_scores[*].category') END AS k FROM o)"""
_STEPS = """w AS (SELECT g.run_id AS before_run_id, lead(g.run_id) OVER (PARTITION BY t.root_url ORDER BY t.crawled_at, g.run_id) AS after_run_id FROM g JOIN (SELECT DISTINCT id, root_url, crawled_at FROM audit_runs) t ON t.id = g.run_id),
e AS (SELECT run_id, json_extract_string(pg, '$.url') AS url, CAST(json_extract_string(pg, '$.score') AS DOUBLE) AS score, row_number() OVER (PARTITION BY run_id, json_extract_string(pg, '$.url') ORDER BY page_no DESC) AS n FROM o),
b AS (SELECT w.*, e.url, e.score FROM w JOIN e ON e.run_id = w.before_run_id AND e.n = 1 WHERE w.after_run_id IS NOT NULL AND e.url IS NOT NULL),
a AS (SELECT w.*, e.url, e.score FROM w JOIN e ON e.run_id = w.after_run_id AND e.n = 1 WHERE e.url IS NOT NULL),
c AS (SELECT coalesce(a.before_run_id, b.before_run_id) AS before_run_id, coalesce(a.after_run_id, b.after_run_id) AS after_run_id, coalesce(a.url, b.url) AS url,
 CASE WHEN b.url IS NULL THEN 'added' WHEN a.url IS NULL THEN 'removed' ELSE 'changed' END AS change_kind, b.score AS before_score, a.score AS after_score
 FROM b FULL JOIN a ON a.after_run_id = b.after_run_id AND a.url = b.url WHERE a.url IS NULL OR b.url IS NULL OR a.score IS DISTINCT FROM b.score)"""

SQL = {
    "p4_found": f"WITH {_READ}, {_LIST} SELECT run_id, page_no, 'page' AS kind, '' AS item FROM o UNION ALL SELECT run_id, page_no, 'finding', CAST(finding_no AS VARCHAR) FROM fi WHERE json_type(f) = 'OBJECT' UNION ALL SELECT run_id, page_no, 'score', unnest(k) FROM s",
    "p4_pages": f"WITH {_READ} SELECT run_id, page_no, json_extract_string(pg, '$.url') AS url, CAST(json_extract_string(pg, '$.score') AS INT) AS score FROM o",
    "p4_findings": f"WITH {_READ}, {_LIST} SELECT run_id, page_no, finding_no, json_extract_string(f, '$.check_id') AS check_id, json_extract_string(f, '$.category') AS category, json_extract_string(f, '$.severity') AS severity, json_extract_string(f, '$.message') AS message, CAST(json_extract_string(f, '$.penalty') AS INT) AS penalty FROM fi WHERE json_type(f) = 'OBJECT'",
    "p4_readable": f"WITH {_READ} SELECT a.id AS run_id, g.run_id IS NOT NULL AS readable, CAST(coalesce(json_array_length(g.pages), 0) AS INT) AS n_pages FROM (SELECT DISTINCT id FROM audit_runs WHERE id IS NOT NULL) a LEFT JOIN g ON g.run_id = a.id",
    "p4_scores": f"""WITH {_READ}, sk AS (SELECT run_id, page_no, pg, unnest(json_keys(pg, '$.category_scores')) AS category FROM o WHERE json_type(pg, '$.category_scores') = 'OBJECT'),
sl AS (SELECT run_id, page_no, unnest(json_extract(pg, '$.category_scores[*]')) AS e FROM o WHERE json_type(pg, '$.category_scores') = 'ARRAY'),
v AS (SELECT run_id, page_no, category, json_extract_string(pg, '$.category_scores."' || category || '"') AS t FROM sk UNION ALL SELECT run_id, page_no, json_extract_string(e, '$.category'), json_extract_string(e, '$.score') FROM sl)
SELECT run_id, page_no, category, CAST(round(TRY_CAST(t AS DOUBLE)) AS INT) AS score FROM v WHERE category IS NOT NULL AND t IS NOT NULL""",
    "p6_found": f"WITH {_READ}, {_STEPS} SELECT before_run_id, after_run_id, url, change_kind FROM c",
    "p6_changes": f"WITH {_READ}, {_STEPS} SELECT * FROM c",
    "p5_found": f"""WITH h AS ({_RUNS}), u AS ({_REPORTS})
SELECT 'host' AS key_kind, host AS key_value FROM h WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= 0.03 * (SELECT count(*) FROM h)
UNION ALL SELECT 'url', url FROM u WHERE url IS NOT NULL GROUP BY url HAVING count(*) >= 0.03 * (SELECT count(*) FROM u)""",
    "p5_hosts": _per_key("host", _RUNS, "site_score", "crawled_at"),
    "p5_urls": _per_key("url", _REPORTS, "score", "reported_at"),
    "p5_score_gaps": f"""WITH r AS ({_REPORTS}), m AS (SELECT url, count(*) AS n, CAST(sum(score) AS DOUBLE) / count(score) AS mean FROM r GROUP BY url)
SELECT r.id AS report_id, r.url, r.score, m.n, round(r.score - m.mean, 6) AS gap FROM r LEFT JOIN m ON m.url = r.url""",
}
