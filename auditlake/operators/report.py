"""Reports: nested assembly, JSON, and text for terminals."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import diff as diffs
from auditlake.operators.rules import CATEGORIES, FINDING
from auditlake.operators.score import truncated_mean

PAGE = f"struct<url:string,findings:array<{FINDING}>,category_scores:map<string,int>,score:int>"
REPORT = f"root string, pages array<{PAGE}>, site_score int, crawled_at string"


def assemble(pages: DataFrame, key: str) -> DataFrame:
    """One report per ``key`` (its root URL): root, pages, site_score, crawled_at.

    The document itself is the result, so its pages are gathered into one row; a report that large is
    better left as tables. Pages are in the order of their URL.
    """
    page = F.struct("url", "findings", "category_scores", "score")
    grouped = pages.groupBy(F.col(key).alias("root")).agg(F.array_sort(F.collect_list(page), lambda a, b: F.when(a["url"] < b["url"], -1).when(a["url"] > b["url"], 1).otherwise(0)).alias("pages"), truncated_mean(F.col("score")).alias("site_score"))
    return grouped.withColumn("crawled_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


def to_json(reports: DataFrame) -> DataFrame:
    """(root, report): each report as indented JSON."""
    return reports.select("root", F.to_json(F.struct("root", "pages", "site_score", "crawled_at"), {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A report file; a missing file or bad JSON is an error."""
    return spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def use_colour(no_colour: bool = False, stream=sys.stdout) -> bool:
    return not no_colour and "NO_COLOR" not in os.environ and stream.isatty()


def _paint(text: str, score: int, colour: bool) -> str:
    return f"\x1b[{32 if score >= 90 else 33 if score >= 70 else 31}m{text}\x1b[0m" if colour else text


def progress_bar(done: int, total: int, width: int = 30) -> str:
    """Pages done of those discovered so far."""
    filled = width if total <= 0 else min(width, width * done // total)
    return f"[{'=' * filled}{' ' * (width - filled)}] {done}/{total}"


def short(url: str, n: int = 60) -> str:
    return url[:n] + "…" if len(url) > n else url


def text_report(report, colour: bool = False, quiet: bool = False) -> str:
    """A report row as text: score, seven bars, pages by score, counts by severity. Quiet: the score alone."""
    score = report["site_score"]
    if quiet:
        return f"{score}\n"
    pages = report["pages"] or []
    lines = [f"Audit of {report['root']}", f"Site score: {_paint(str(score), score, colour)}", ""]
    for name, _ in CATEGORIES:
        own = [p["category_scores"][name] for p in pages if p["category_scores"] and name in p["category_scores"]]
        mean = sum(own) // len(own) if own else 0
        bar = (mean + 5) // 10
        lines.append(f"{name:<14} {_paint('█' * bar + '░' * (10 - bar), mean, colour)} {mean}")
    lines += ["", f"{'Page':<62}{'Score':>6}{'Crit':>6}{'Warn':>6}{'Info':>6}"]
    for p in sorted(pages, key=lambda p: p["score"]):
        n = [sum(f["severity"] == s for f in p["findings"] or []) for s in ("Critical", "Warning", "Info")]
        lines.append(f"{short(p['url']):<62}{_paint(f'{p["score"]:>6}', p['score'], colour)}{n[0]:>6}{n[1]:>6}{n[2]:>6}")
    return "\n".join(lines) + "\n"


def diff_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: both scores, their delta, deltas by category, the page changes, both roots."""
    side = lambda df: df.select(F.posexplode("pages").alias("pos", "p")).select("pos", "p.url", "p.score", "p.category_scores")
    b, a = side(before), side(after)
    last = lambda df: diffs.last_entries(df, ["url"], "pos", ["score"])
    pages = diffs.page_diff(last(b), last(a), ["url"])
    cats = lambda df: df.select(F.explode("category_scores").alias("category", "score"))
    deltas = diffs.category_deltas(cats(b), cats(a), [])
    entry = F.struct("delta", "url", "kind", "before_score", "after_score")
    page_list = pages.agg(F.array_sort(F.collect_list(entry)).alias("pages"))
    delta_map = deltas.agg(F.map_from_entries(F.collect_list(F.struct("category", "delta"))).alias("category_deltas"))
    top = before.select(F.col("root").alias("before_root"), F.col("site_score").alias("before_site_score"))
    new = after.select(F.col("root").alias("after_root"), F.col("site_score").alias("after_site_score"))
    one = F.broadcast
    return (
        top.join(one(new)).join(one(page_list)).join(one(delta_map)).select("before_site_score", "after_site_score", (F.col("after_site_score") - F.col("before_site_score")).alias("site_score_delta"), "category_deltas", "pages", "before_root", "after_root")
    )


def _signed(n: int) -> str:
    return f"+{n}" if n > 0 else str(n)


def text_diff(d, colour: bool = False) -> str:
    """A diff row as text."""
    pages = d["pages"]
    changed = [p for p in pages if p["kind"] == "Changed"]
    count = lambda k: sum(p["kind"] == k for p in pages)
    lines = [
        f"Site score: {d['before_site_score']} → {d['after_site_score']} ({_signed(d['site_score_delta'])})",
        f"Regressions: {sum(p['delta'] < 0 for p in changed)}  Improvements: {sum(p['delta'] >= 0 for p in changed)}  Unchanged: {count('Unchanged')}  Added: {count('Added')}  Removed: {count('Removed')}",
        "",
        f"{'Category':<14}{'Before':>8}{'After':>8}{'Delta':>8}",
    ]
    lines += [f"{k:<14}{'—':>8}{'—':>8}{_signed(d['category_deltas'][k]):>8}" for k, _ in CATEGORIES if k in d["category_deltas"]]
    lines += ["", f"{'Page':<62}{'Kind':<10}{'Before':>8}{'After':>8}{'Delta':>8}"]
    text = lambda n: "—" if n is None else str(n)
    for p in pages:
        shown = f"{_signed(p['delta']):>8}"
        lines.append(f"{short(p['url']):<62}{p['kind']:<10}{text(p['before_score']):>8}{text(p['after_score']):>8}" + (f"\x1b[{31 if p['delta'] < 0 else 32}m{shown}\x1b[0m" if colour and p["delta"] else shown))
    return "\n".join(lines) + "\n"
