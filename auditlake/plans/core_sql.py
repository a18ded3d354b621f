"""SQL that gives the same results as the queries of ``core`` (DuckDB dialect).

Facts are read with regular expressions here, with a parser there. An entity counts as one character.
"""

from __future__ import annotations

from auditlake.operators.rules import CATEGORIES
from auditlake.plans.core import ROBOTS

_WEIGHT = {k: w for k, w in CATEGORIES}
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

_H = r"""h AS (SELECT page_id, url, redirect_chain, coalesce(html, '') AS html,
 regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g') AS b FROM page)"""


def _chars(text: str) -> str:
    return rf"length(trim(regexp_replace({text}, '&(#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z]+);', 'x', 'g'), {_BLANK}))"


def _finding(check: str, category: str, severity: str, penalty: int) -> str:
    return f"page_id, '{check}' AS check_id, '{category}' AS category, '{severity}' AS severity, {penalty} AS penalty"


_TITLE = rf"""tt AS (SELECT page_id, regexp_matches(b, '(?i)<title') AS has, {_chars("regexp_extract(b, '(?is)<title[^>]*>(.*?)</title', 1)")} AS n FROM h),
title_f AS (SELECT {_finding("title.missing", "Metadata", "Critical", 30)} FROM tt WHERE NOT has
 UNION ALL SELECT {_finding("title.empty", "Metadata", "Critical", 30)} FROM tt WHERE has AND n = 0
 UNION ALL SELECT {_finding("title.short", "Metadata", "Warning", 15)} FROM tt WHERE has AND n BETWEEN 1 AND 29
 UNION ALL SELECT {_finding("title.long", "Metadata", "Warning", 10)} FROM tt WHERE has AND n > 60)"""
_DESCRIPTION = rf"""dd AS (SELECT page_id, regexp_matches(b, '(?is)<meta\s[^>]*name="description"') AS has, {_chars('regexp_extract(b, \'(?is)<meta\\s[^>]*name="description"\\s[^>]*content="([^"]*)"\', 1)')} AS n FROM h),
description_f AS (SELECT {_finding("description.missing", "Metadata", "Warning", 20)} FROM dd WHERE NOT has
 UNION ALL SELECT {_finding("description.empty", "Metadata", "Warning", 20)} FROM dd WHERE has AND n = 0
 UNION ALL SELECT {_finding("description.short", "Metadata", "Warning", 10)} FROM dd WHERE has AND n BETWEEN 1 AND 49
 UNION ALL SELECT {_finding("description.long", "Metadata", "Info", 5)} FROM dd WHERE has AND n > 160)"""
_CANONICAL = rf"""cc AS (SELECT page_id, url, regexp_extract_all(b, '(?is)<link\s[^>]*rel="canonical"[^>]*>') AS tags FROM h),
c1 AS (SELECT page_id, url, len(tags) AS n, regexp_extract(tags[1], 'href="([^"]*)"', 1) AS c FROM cc),
canonical_f AS (SELECT {_finding("canonical.missing", "Metadata", "Warning", 10)} FROM c1 WHERE n = 0
 UNION ALL SELECT {_finding("canonical.invalid", "Metadata", "Warning", 10)} FROM c1 WHERE n > 0 AND NOT regexp_matches(c, '^[a-z]+://')
 UNION ALL SELECT {_finding("canonical.off-host", "Metadata", "Warning", 15)} FROM c1 WHERE n > 0 AND regexp_matches(c, '^[a-z]+://') AND regexp_extract(c, '://([^/:?#]*)', 1) <> regexp_extract(url, '://([^/:?#]*)', 1)
 UNION ALL SELECT {_finding("canonical.multiple", "Metadata", "Warning", 10)} FROM c1 WHERE n > 1
 UNION ALL SELECT {_finding("canonical.not-self-referential", "Metadata", "Info", 5)} FROM c1 WHERE n > 0 AND regexp_extract(c, '://([^/:?#]*)', 1) = regexp_extract(url, '://([^/:?#]*)', 1) AND regexp_extract(c, '://[^/]*(.*)', 1) <> regexp_extract(url, '://[^/]*(.*)', 1))"""
_HEADINGS = rf"""hh AS (SELECT page_id, len(regexp_extract_all(b, '(?i)<h1[\s>]')) AS ones, len(regexp_extract_all(b, '(?is)<h[1-6][^>]*>\s*</h[1-6]\s*>')) AS empty, list_sort(list_distinct(list_transform(regexp_extract_all(b, '(?i)<h([1-6])[\s>]', 1), lambda x: CAST(x AS INT)))) AS levels FROM h),
lv AS (SELECT page_id, unnest(levels) AS l FROM hh), lp AS (SELECT page_id, l, lag(l) OVER (PARTITION BY page_id ORDER BY l) AS p FROM lv),
headings_f AS (SELECT {_finding("headings.no-h1", "Structure", "Critical", 40)} FROM hh WHERE ones = 0
 UNION ALL SELECT {_finding("headings.multiple-h1", "Structure", "Warning", 20)} FROM hh WHERE ones > 1
 UNION ALL SELECT {_finding("headings.empty", "Structure", "Warning", 10)} FROM (SELECT page_id, unnest(range(empty)) AS i FROM hh)
 UNION ALL SELECT {_finding("headings.skipped-level", "Structure", "Warning", 10)} FROM lp WHERE l - p > 1)"""
_SOCIAL = (
    "social_f AS ("
    + " UNION ALL ".join(f"""SELECT {_finding(f"og.{k}.missing", "SocialTags", "Info", 10)} FROM h WHERE NOT regexp_matches(b, '(?is)<meta\\s[^>]*property="og:{k}"\\s[^>]*content="[^"]*[^\\s"][^"]*"')""" for k in ("title", "description", "image", "url"))
    + f""" UNION ALL SELECT {_finding("twitter.card.missing", "SocialTags", "Info", 10)} FROM h WHERE NOT regexp_matches(b, '(?is)<meta\\s[^>]*name="twitter:card"\\s[^>]*content="[^"]*[^\\s"][^"]*"'))"""
)
_IMAGES = rf"""im AS (SELECT page_id, unnest(regexp_extract_all(b, '(?is)<img\b[^>]*>')) AS t FROM h),
images_f AS (SELECT {_finding("images.missing-alt", "Media", "Warning", 5)} FROM im WHERE NOT regexp_matches(t, 'src="data:') AND NOT regexp_matches(t, '\salt=')
 UNION ALL SELECT {_finding("images.empty-alt", "Media", "Info", 2)} FROM im WHERE NOT regexp_matches(t, 'src="data:') AND regexp_matches(t, '\salt=""'))"""
_HTTPS = rf"""rs AS (SELECT page_id, url, unnest(list_concat(regexp_extract_all(html, '(?is)<(?:img|script|iframe|audio|video|source|track|embed)\b[^>]*\ssrc="([^"]*)"', 1), regexp_extract_all(html, '(?is)<link\b[^>]*\shref="([^"]*)"', 1))) AS r FROM h),
https_f AS (SELECT {_finding("https.insecure", "Security", "Critical", 40)} FROM h WHERE url NOT LIKE 'https://%'
 UNION ALL SELECT {_finding("https.mixed-content", "Security", "Warning", 20)} FROM rs WHERE url LIKE 'https://%' AND starts_with(r, 'http://'))"""
_REDIRECTS = f"""redirects_f AS (SELECT {_finding("redirects.chain-excessive", "Links", "Critical", 30)} FROM h WHERE len(redirect_chain) > 5
 UNION ALL SELECT {_finding("redirects.chain-long", "Links", "Warning", 15)} FROM h WHERE len(redirect_chain) BETWEEN 4 AND 5)"""
_SCRIPTED = rf"""sc AS (SELECT page_id, strlen(html) AS n, list_sum(list_transform(regexp_split_to_array(b, '<[^>]*>'), lambda x: strlen(trim(x, {_BLANK})))) AS t, len(regexp_extract_all(b, '(?i)<(?:p|article|section|main|li|h[1-6])[\s>]')) AS tags FROM h),
scripted_f AS (SELECT {_finding("js-rendered.likely", "Structure", "Warning", 10)} FROM sc WHERE n > 0 AND CAST(t AS DOUBLE) / n < 0.05 AND tags < 3)"""
_RULES = {"title": _TITLE, "description": _DESCRIPTION, "canonical": _CANONICAL, "headings": _HEADINGS, "https": _HTTPS, "social": _SOCIAL, "images": _IMAGES, "redirects": _REDIRECTS, "scripted": _SCRIPTED}


def _rule(name: str) -> str:
    return f"WITH {_H}, {_RULES[name]} SELECT * FROM {name}_f"


_ALL = f"WITH {_H}, " + ", ".join(_RULES.values()) + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM {k}_f" for k in _RULES) + ")"
_CAT = ", ".join(f"greatest(0, 100 - coalesce(sum(penalty) FILTER (WHERE category = '{k}'), 0)) AS {k.lower()}" for k in _WEIGHT)
_SUM = " + ".join(f"{k.lower()} * {w}" for k, w in _WEIGHT.items())

_LINKS = r"""l AS (SELECT DISTINCT page_id, host, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(href, '&amp;', '&') AS target FROM
 (SELECT page_id, url, regexp_extract(url, '://([^/:?#]*)', 1) AS host, unnest(regexp_extract_all(b, '(?is)<a\s[^>]*href="([^"#]*)', 1)) AS href FROM h) WHERE url IS NOT NULL AND starts_with(href, '/'))"""

_REPORTS = "SELECT DISTINCT report_id, job_id, host, url, score, n_findings, reported_at FROM page_report"
_FINDINGS = "SELECT DISTINCT finding_id, report_id, category, severity, penalty FROM finding"
_CATEGORIES = "(VALUES " + ", ".join(f"('{k}', {w})" for k, w in CATEGORIES) + ") AS c(category, weight)"
_CATEGORY_SCORES = f"""f AS ({_FINDINGS}), p AS (SELECT DISTINCT report_id FROM page_report), s AS (SELECT report_id, category, sum(penalty) AS penalty FROM f GROUP BY report_id, category),
cs AS (SELECT p.report_id, c.category, c.weight, CAST(greatest(0, least(100, 100 - coalesce(s.penalty, 0))) AS INT) AS category_score FROM p CROSS JOIN {_CATEGORIES} LEFT JOIN s ON s.report_id = p.report_id AND s.category = c.category)"""
_CATEGORY_ROWS = "cr AS (SELECT report_id, host, unnest(map_keys(category_scores)) AS category, unnest(map_values(category_scores)) AS score FROM (SELECT report_id, any_value(host) AS host, any_value(category_scores) AS category_scores FROM page_report GROUP BY report_id))"
_JOBS = f"""r AS ({_REPORTS}), j AS (SELECT host, job_id, max(reported_at) AS seen FROM r WHERE host IS NOT NULL AND job_id IS NOT NULL GROUP BY host, job_id),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seen DESC, job_id DESC) AS place FROM j),
e AS (SELECT r.host, r.url, r.score, k.place, row_number() OVER (PARTITION BY r.host, r.url, k.place ORDER BY r.reported_at DESC, r.report_id DESC) AS n FROM r JOIN k ON k.host = r.host AND k.job_id = r.job_id AND k.place <= 2),
b AS (SELECT host, url, score FROM e WHERE place = 2 AND n = 1), a AS (SELECT host, url, score FROM e WHERE place = 1 AND n = 1),
d AS (SELECT coalesce(a.host, b.host) AS host, coalesce(a.url, b.url) AS url,
 CASE WHEN b.url IS NULL THEN 'Added' WHEN a.url IS NULL THEN 'Removed' WHEN a.score IS NOT DISTINCT FROM b.score THEN 'Unchanged' ELSE 'Changed' END AS kind,
 b.score AS before_score, a.score AS after_score, CASE WHEN a.url IS NOT NULL AND b.url IS NOT NULL THEN coalesce(a.score - b.score, 0) ELSE 0 END AS delta
 FROM b FULL JOIN a ON a.host = b.host AND a.url = b.url)"""
_HISTORY = f"""hr AS (SELECT DISTINCT id, nullif(lower(trim(host, {_BLANK})), '') AS host, site_score, crawled_at FROM audit_runs)"""
_BODIES = ", ".join("'" + b.replace("\n", "' || chr(10) || '") + "'" for b in ROBOTS)
_ROBOTS = f"""ro AS (SELECT host, ([{_BODIES}])[length(host) % {len(ROBOTS)} + 1] AS body, length(host) % {len(ROBOTS)} AS which FROM (SELECT DISTINCT host FROM page WHERE host IS NOT NULL)),
ln AS (SELECT host, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS pos FROM ro),
cl AS (SELECT host, pos, trim(string_split(raw, '#')[1]) AS line FROM ln),
bl AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY pos) AS block FROM cl),
kv AS (SELECT host, block, lower(trim(string_split(line, ':')[1])) AS name, trim(substr(line, instr(line, ':') + 1)) AS value FROM bl WHERE line LIKE '%:%'),
rr AS (SELECT u.host, lower(u.value) AS ua, x.name AS kind, x.value AS prefix FROM kv u JOIN kv x ON x.host = u.host AND x.block = u.block WHERE u.name = 'user-agent' AND x.name IN ('allow', 'disallow') AND x.value <> '')"""

SQL = {
    "title_rules": _rule("title"),
    "description_rules": _rule("description"),
    "heading_rules": _rule("headings"),
    "social_rules": _rule("social"),
    "image_rules": _rule("images"),
    "https_rules": _rule("https"),
    "redirect_rules": _rule("redirects"),
    "canonical_rules": _rule("canonical"),
    "scripted_rules": _rule("scripted"),
    "page_facts": f"WITH {_H}" + r""" SELECT page_id, len(regexp_extract_all(b, '(?i)<h[1-6][\s>]')) AS n_headings, len(regexp_extract_all(b, '(?i)<img\b')) AS n_images, len(regexp_extract_all(b, '(?is)<a\s[^>]*href=')) AS n_links, len(regexp_extract_all(b, '(?is)<link\s[^>]*rel="canonical"')) AS n_canonicals, strlen(html) AS html_bytes FROM h""",
    "audited_pages": f"{_ALL}, sums AS (SELECT h.page_id, h.url, {_CAT} FROM h LEFT JOIN every ON every.page_id = h.page_id GROUP BY h.page_id, h.url) SELECT *, ({_SUM} + 50) // 100 AS score FROM sums",
    "page_links": f"WITH {_H}, {_LINKS} SELECT page_id, target, 'internal' AS kind FROM l",
    "top_linked": f"WITH {_H}, {_LINKS}, n AS (SELECT host, target, count(*) AS n_links FROM l GROUP BY host, target), w AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n_links DESC, target) AS place FROM n) SELECT * FROM w WHERE place <= 10",
    "probe_classes": f"""WITH {_H}, {_LINKS}, m AS (SELECT target, CAST('0x' || substr(md5(target), 1, 2) AS INT) AS d FROM l),
s AS (SELECT CASE WHEN d < 160 THEN 200 WHEN d < 190 THEN 404 WHEN d < 210 THEN 500 WHEN d < 245 THEN 200 ELSE 0 END AS status FROM m),
f AS (SELECT CASE WHEN status = 404 THEN 'links.broken-4xx' WHEN status = 500 THEN 'links.broken-5xx' WHEN status = 0 THEN 'links.unreachable' END AS check_id FROM s)
SELECT check_id, CASE WHEN check_id = 'links.broken-5xx' THEN 'Critical' ELSE 'Warning' END AS severity, CASE WHEN check_id = 'links.broken-5xx' THEN 20 ELSE 10 END AS penalty, count(*) AS n FROM f WHERE check_id IS NOT NULL GROUP BY check_id""",
    "url_normal_forms": r"""WITH u AS (SELECT page_id, string_split(url, '#')[1] AS bare FROM page),
q AS (SELECT page_id, lower(regexp_extract(bare, '^([a-zA-Z]+://[^/?]*)', 1)) AS host, regexp_extract(bare, '^[a-zA-Z]+://[^/?]*([^?]*)', 1) AS path, CASE WHEN instr(bare, '?') > 0 THEN substr(bare, instr(bare, '?') + 1) ELSE '' END AS query FROM u),
s AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND string_split(x, '=')[1] NOT IN ('fbclid', 'gclid', 'mc_eid', 'ref', 'igshid')) AS pairs FROM q),
t AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(pairs, lambda x: {'k': string_split(x, '=')[1], 'i': list_position(pairs, x), 'p': CASE WHEN instr(x, '=') > 0 THEN x ELSE x || '=' END})), lambda z: z.p), '&') AS text FROM s)
SELECT page_id, CASE WHEN regexp_matches(host, '^https?://.') THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN text = '' THEN '' ELSE '?' || text END END AS normal FROM t""",
    "same_host_urls": f"SELECT report_id, coalesce(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':(80|443)$', '') = host, FALSE) AS on_host FROM ({_REPORTS})",
    "category_scores": f"WITH {_CATEGORY_SCORES} SELECT report_id, category, category_score FROM cs",
    "page_scores": f"WITH {_CATEGORY_SCORES} SELECT report_id, CAST((sum(category_score * weight) + 50) // 100 AS INT) AS score FROM cs GROUP BY report_id",
    "site_scores": f"SELECT host, count(score) AS n_pages, CAST(coalesce(sum(score) // nullif(count(score), 0), 0) AS INT) AS site_score FROM ({_REPORTS}) WHERE host IS NOT NULL GROUP BY host",
    "category_means": f"WITH {_CATEGORY_ROWS}, m AS (SELECT host, category, CAST(coalesce(sum(score) // nullif(count(score), 0), 0) AS INT) AS mean FROM cr WHERE host IS NOT NULL GROUP BY host, category) SELECT *, (mean + 5) // 10 AS bar FROM m",
    "severity_counts": f"SELECT report_id, count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE severity = 'Warning') AS warning, count(*) FILTER (WHERE severity = 'Info') AS info FROM ({_FINDINGS}) GROUP BY report_id",
    "score_bands": f"SELECT CASE WHEN score >= 90 THEN 'good' WHEN score >= 70 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM ({_REPORTS}) WHERE score IS NOT NULL GROUP BY 1",
    "report_diff": f"WITH {_JOBS} SELECT * FROM d",
    "report_diff_summary": f"WITH {_JOBS} SELECT host, count(*) FILTER (WHERE kind = 'Changed' AND delta < 0) AS regressions, count(*) FILTER (WHERE kind = 'Changed' AND delta >= 0) AS improvements, count(*) FILTER (WHERE kind = 'Unchanged') AS unchanged, count(*) FILTER (WHERE kind = 'Added') AS added, count(*) FILTER (WHERE kind = 'Removed') AS removed FROM d GROUP BY host",
    "job_category_deltas": f"""WITH {_JOBS}, cr AS (SELECT host, job_id, unnest(map_keys(c)) AS category, unnest(map_values(c)) AS score FROM (SELECT any_value(host) AS host, any_value(job_id) AS job_id, any_value(category_scores) AS c FROM page_report GROUP BY report_id)),
g AS (SELECT cr.host, category, place, sum(cr.score) // count(cr.score) AS m FROM cr JOIN k ON k.host = cr.host AND k.job_id = cr.job_id AND k.place <= 2 WHERE cr.score IS NOT NULL GROUP BY cr.host, category, place)
SELECT host, category, CAST(coalesce(max(m) FILTER (WHERE place = 1), 0) - coalesce(max(m) FILTER (WHERE place = 2), 0) AS INT) AS delta FROM g GROUP BY host, category""",
    "report_diff_lines": f"WITH {_JOBS} SELECT host, CASE WHEN length(url) > 60 THEN left(url, 60) || '…' ELSE url END AS page, kind, CASE WHEN delta > 0 THEN '+' ELSE '' END || delta AS change FROM d",
    "rule_messages": f"WITH {_H}, {', '.join(_RULES[k] for k in ('title', 'description', 'headings', 'social', 'redirects', 'scripted', 'https'))}, em AS (SELECT page_id, unnest(regexp_extract_all(b, '(?is)<h([1-6])[^>]*>\\s*</h[1-6]\\s*>', 1)) AS l FROM h), " + """m AS (
 SELECT page_id, 'title.missing' AS check_id, 'Page has no <title> tag' AS message FROM tt WHERE NOT has UNION ALL SELECT page_id, 'title.empty', 'Title tag is empty' FROM tt WHERE has AND n = 0
 UNION ALL SELECT page_id, 'title.short', 'Title is ' || n || ' chars (min 30)' FROM tt WHERE has AND n BETWEEN 1 AND 29 UNION ALL SELECT page_id, 'title.long', 'Title is ' || n || ' chars (max 60)' FROM tt WHERE has AND n > 60
 UNION ALL SELECT page_id, 'description.missing', 'Page has no meta description' FROM dd WHERE NOT has UNION ALL SELECT page_id, 'description.empty', 'Meta description is empty' FROM dd WHERE has AND n = 0
 UNION ALL SELECT page_id, 'description.short', 'Meta description is ' || n || ' chars (min 50)' FROM dd WHERE has AND n BETWEEN 1 AND 49 UNION ALL SELECT page_id, 'description.long', 'Meta description is ' || n || ' chars (max 160)' FROM dd WHERE has AND n > 160
 UNION ALL SELECT page_id, 'headings.no-h1', 'Page has no <h1>' FROM hh WHERE ones = 0 UNION ALL SELECT page_id, 'headings.multiple-h1', 'Page has ' || ones || ' <h1> elements; expected exactly 1' FROM hh WHERE ones > 1
 UNION ALL SELECT page_id, 'headings.empty', '<h' || l || '> is empty' FROM em UNION ALL SELECT page_id, 'headings.skipped-level', 'Heading level skipped: h' || p || ' → h' || l FROM lp WHERE l - p > 1
 UNION ALL SELECT page_id, check_id, CASE WHEN check_id = 'twitter.card.missing' THEN 'Missing or empty meta tag: twitter:card' ELSE 'Missing or empty OpenGraph tag: ' || replace(replace(check_id, '.missing', ''), '.', ':') END FROM social_f
 UNION ALL SELECT page_id, 'redirects.chain-excessive', 'Redirect chain is ' || len(redirect_chain) || ' hops (max 5); excessive redirects hurt crawlability' FROM h WHERE len(redirect_chain) > 5
 UNION ALL SELECT page_id, 'redirects.chain-long', 'Redirect chain is ' || len(redirect_chain) || ' hops (recommended max 3)' FROM h WHERE len(redirect_chain) BETWEEN 4 AND 5
 UNION ALL SELECT page_id, check_id, 'page appears to require JS rendering — results may be incomplete' FROM scripted_f
 UNION ALL SELECT page_id, 'https.insecure', 'Page served over ' || regexp_extract(url, '^([a-z]+):', 1) || '; HTTPS required' FROM h WHERE url NOT LIKE 'https://%'
 UNION ALL SELECT page_id, 'https.mixed-content', 'Mixed content: http resource on https page — ' || r FROM rs WHERE url LIKE 'https://%' AND starts_with(r, 'http://')) SELECT * FROM m""",
    "robots_states": f"""WITH {_ROBOTS}, x AS (SELECT * FROM (VALUES (1, 'robots.no-sitemap'), (2, 'robots.disallow-all'), (2, 'robots.no-sitemap'), (3, 'robots.disallow-all'), (9, 'robots.missing')) AS v(which, check_id)), st AS (SELECT host, CASE WHEN CAST('0x' || substr(md5(host), 1, 2) AS INT) < 128 THEN 9 ELSE which END AS which FROM ro)
SELECT host, check_id, CASE check_id WHEN 'robots.missing' THEN 'robots.txt not found or inaccessible' WHEN 'robots.disallow-all' THEN 'robots.txt disallows all crawlers (Disallow: / for User-agent: *)' ELSE 'robots.txt does not contain a Sitemap: directive' END AS message FROM st JOIN x ON x.which = st.which""",
    "sitemap_rules": """WITH s AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 2) AS INT) AS d FROM page WHERE host IS NOT NULL)
SELECT host, CASE WHEN d < 50 THEN 'sitemap.missing' WHEN d < 100 THEN 'sitemap.malformed' ELSE 'sitemap.url-unreachable' END AS check_id,
 CASE WHEN d < 50 THEN 'sitemap.xml not found or inaccessible' WHEN d < 100 THEN 'sitemap.xml is present but could not be parsed as valid XML' ELSE 'Sitemap URL https://' || host || '/dead unreachable (status 404)' END AS message FROM s WHERE d < 190""",
    "redirect_loops": """WITH s AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 2) AS INT) AS d FROM page WHERE host IS NOT NULL), n AS (SELECT host, d, CASE WHEN d < 85 THEN 2 WHEN d < 170 THEN 3 ELSE 11 END AS n_hops FROM s)
SELECT host, CAST(n_hops AS INT) AS n_hops, CASE WHEN d < 85 OR d >= 170 THEN 'RedirectLoop' END AS error, CASE WHEN d < 85 OR d >= 170 THEN 'Redirect loop detected at https://' || host || '/0 after ' || n_hops || ' hops' END AS message FROM n""",
    "retried_responses": """WITH s AS (SELECT DISTINCT url, CAST('0x' || substr(md5(url), 1, 2) AS INT) AS d FROM page WHERE url IS NOT NULL), a AS (SELECT url, d, CAST(CASE WHEN d < 85 THEN 1 WHEN d < 170 THEN 3 ELSE 0 END AS INT) AS attempt FROM s)
SELECT url, CAST(CASE WHEN d BETWEEN 85 AND 169 THEN 503 ELSE 200 END AS INT) AS status, attempt, CAST(CASE WHEN d < 40 THEN 7 ELSE pow(2, attempt) END AS BIGINT) AS wait FROM a""",
    "decoded_bodies": """SELECT page_id, CASE WHEN CAST('0x' || substr(md5(url), 1, 2) AS INT) BETWEEN 85 AND 169 THEN '<meta charset="iso-8859-1">' ELSE '' END || 'naïve ' || url AS text FROM page WHERE regexp_full_match(url, '[ -~]*')""",
    "history_topk": f"WITH {_HISTORY}, w AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY crawled_at DESC, id DESC) AS place FROM hr WHERE host IS NOT NULL) SELECT host, id, site_score, place FROM w WHERE place <= 3",
    "score_regressions": f"""WITH {_HISTORY}, w AS (SELECT host, site_score, row_number() OVER (PARTITION BY host ORDER BY crawled_at DESC, id DESC) AS place FROM hr WHERE host IS NOT NULL AND site_score IS NOT NULL),
t AS (SELECT host, max(site_score) FILTER (WHERE place = 1) AS newest_score, max(site_score) FILTER (WHERE place = 2) AS previous_score FROM w GROUP BY host)
SELECT *, newest_score - previous_score AS delta_points, coalesce(newest_score - previous_score < -5, FALSE) AS regressed FROM t""",
    "history_chart": f"""WITH {_HISTORY}, w AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY crawled_at DESC, id DESC) AS place FROM hr WHERE host IS NOT NULL AND site_score IS NOT NULL),
k AS (SELECT *, max(place) OVER (PARTITION BY host) AS points FROM w WHERE place <= 20)
SELECT host, id, site_score, round((points - place) * 600.0 / (points - 1), 4) AS x, round(160 - site_score * 160.0 / 100, 4) AS y FROM k WHERE points >= 2""",
    "crawl_bfs": f"""WITH RECURSIVE {_H}, {_LINKS}, e AS (SELECT DISTINCT url AS src, target AS dst FROM l), s AS (SELECT regexp_extract(url, '://([^/:?#]*)', 1) AS job_id, min(url) AS url FROM page WHERE url IS NOT NULL GROUP BY 1),
r AS (SELECT job_id, url, 0 AS depth FROM s UNION SELECT r.job_id, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 3) SELECT job_id, url, min(depth) AS depth FROM r GROUP BY job_id, url""",
    "redirect_targets": """WITH RECURSIVE c AS (SELECT list_append(redirect_chain, url) AS c FROM page WHERE len(redirect_chain) > 0 AND url IS NOT NULL),
p AS (SELECT unnest(c[:-2]) AS src, unnest(c[2:]) AS dst FROM c), g AS (SELECT src, min(dst) AS dst FROM p WHERE src <> dst GROUP BY src),
r AS (SELECT src AS url, src AS here, CAST([] AS VARCHAR[]) AS chain, FALSE AS is_loop FROM g UNION ALL
 SELECT r.url, CASE WHEN list_contains(list_append(r.chain, r.here), g.dst) THEN r.here ELSE g.dst END, list_append(r.chain, r.here), list_contains(list_append(r.chain, r.here), g.dst) FROM r JOIN g ON g.src = r.here WHERE NOT r.is_loop AND len(r.chain) < 10),
w AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY len(chain) DESC) AS n FROM r) SELECT url, here AS final, len(chain) AS n_hops, is_loop FROM w WHERE n = 1""",
    "robots_rules": f"WITH {_ROBOTS} SELECT * FROM rr",
    "robots_decisions": f"""WITH {_ROBOTS}, nm AS (SELECT *, ua <> '*' AND instr('auditlake/0.1', ua) > 0 AS own FROM rr), us AS (SELECT * FROM nm WHERE own OR ua = '*'), sc AS (SELECT host, max(own) AS own FROM us GROUP BY host),
ru AS (SELECT us.* FROM us JOIN sc ON sc.host = us.host AND sc.own = us.own), pg AS (SELECT page_id, host, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM page)
SELECT pg.page_id, coalesce(max(strlen(prefix)) FILTER (WHERE kind = 'allow'), -1) >= coalesce(max(strlen(prefix)) FILTER (WHERE kind = 'disallow'), -1) AS allowed FROM pg LEFT JOIN ru ON ru.host = pg.host AND starts_with(pg.path, ru.prefix) GROUP BY pg.page_id""",
    "robots_findings": f"WITH {_ROBOTS}, x AS (SELECT * FROM (VALUES (1, 'robots.no-sitemap', 'Info', 5), (2, 'robots.disallow-all', 'Critical', 40), (2, 'robots.no-sitemap', 'Info', 5), (3, 'robots.disallow-all', 'Critical', 40)) AS v(which, check_id, severity, penalty)) SELECT host, check_id, severity, penalty FROM ro JOIN x ON x.which = ro.which",
    "crawl_delay_by_host": f"WITH {_ROBOTS} SELECT host, CAST(max(CAST(value AS DOUBLE)) AS DOUBLE) AS delay FROM kv WHERE name = 'crawl-delay' GROUP BY host",
    "sitemap_locs": "SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY url) - 1 AS INT) AS pos, url AS loc FROM (SELECT DISTINCT host, url FROM page WHERE host IS NOT NULL AND url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY host ORDER BY url) <= 50",
    "charset_labels": r"SELECT page_id, nullif(lower(regexp_extract(coalesce(headers['content-type'], ''), '(?i)charset=\s*[\x22\x27]?([^\s;\x22\x27]+)', 1)), '') AS charset FROM page",
    "progress_stream": f"SELECT job_id, count(*) AS pages_done, avg(score) AS mean_score FROM ({_REPORTS}) GROUP BY job_id",
    "rate_limit_windows": """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT user_id, event_id, n, t AS anchor, 1 AS k, 1 AS w FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - r.anchor >= 86400000000 THEN e.t ELSE r.anchor END, CASE WHEN e.t - r.anchor >= 86400000000 THEN 1 ELSE r.k + 1 END, CASE WHEN e.t - r.anchor >= 86400000000 THEN r.w + 1 ELSE r.w END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, w AS window_no, k AS n_in_window, k <= 5 AS allowed FROM r""",
    "grant_times": """WITH p AS (SELECT page_id, host, epoch_us(fetched_at) / 1e6 AS t FROM page WHERE host IS NOT NULL AND fetched_at IS NOT NULL),
i AS (SELECT *, row_number() OVER w - 1 AS i FROM p WINDOW w AS (PARTITION BY host ORDER BY t, page_id)),
f AS (SELECT *, max(t - i / 2.0) OVER (PARTITION BY host ORDER BY t, page_id ROWS UNBOUNDED PRECEDING) + (i + 1) / 2.0 AS full_at FROM i),
b AS (SELECT *, greatest(t, coalesce(lag(full_at) OVER (PARTITION BY host ORDER BY t, page_id), t) - 0.5) AS due FROM f)
SELECT page_id, round(max(due - i) OVER (PARTITION BY host ORDER BY t, page_id ROWS UNBOUNDED PRECEDING) + i, 3) AS granted FROM b""",
}
