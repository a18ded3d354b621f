"""Command line: ``audit URL``, ``diff BEFORE AFTER`` and ``serve``."""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import history, report
from auditlake.plans.audit import Config, audit
from auditlake.session import get_spark
from auditlake.sources import http
from auditlake.sources.web import live


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="auditlake")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="audit a site")
    a.add_argument("url")
    a.add_argument("-d", "--depth", type=int, default=1)
    a.add_argument("-c", "--concurrency", type=int, default=8)
    a.add_argument("--rate", type=int, default=2)
    a.add_argument("--user-agent", default=http.USER_AGENT)
    a.add_argument("--timeout", type=int, default=30)
    a.add_argument("--max-pages", type=int)
    a.add_argument("--global-timeout", type=int)
    a.add_argument("--ignore-robots", action="store_true")
    a.add_argument("--validate-sitemap", action="store_true")
    a.add_argument("--check-external-links", action="store_true")
    a.add_argument("-q", "--quiet", action="store_true")
    a.add_argument("--no-color", action="store_true")
    a.add_argument("-o", "--output")
    a.add_argument("--verbose", action="store_true")
    a.add_argument("--redis-url", default=os.environ.get("REDIS_URL"), help="accepted, not needed: the frontier is a table")
    a.add_argument("--history", default=os.environ.get("AUDIT_HISTORY"), help="history table that the run is added to")
    d = sub.add_parser("diff", help="compare two reports")
    d.add_argument("before")
    d.add_argument("after")
    d.add_argument("-f", "--output", choices=("text", "json"), default="text")
    d.add_argument("--no-color", action="store_true")
    s = sub.add_parser("serve", help="run audits over HTTP")
    s.add_argument("--bind", default="127.0.0.1:7878")
    return p


def config_of(args: argparse.Namespace) -> Config:
    return Config(args.depth, args.rate, args.max_pages, args.timeout, args.global_timeout, args.user_agent, args.ignore_robots, args.validate_sitemap, args.check_external_links, args.concurrency)


def run_audit(spark: SparkSession, url: str, config: Config, web=None, on_pages=None) -> DataFrame:
    """The report of one root as a one-row frame; a crawl that found nothing has score 0."""
    deadline = {} if config.global_timeout is None else {"deadline": time.time() + config.global_timeout}
    web = web or live(config.concurrency, rate=config.rate, timeout=config.timeout, user_agent=config.user_agent, **deadline)
    seeds = spark.createDataFrame([("job", url)], "job_id string, url string")
    pages = audit(seeds, web, config, on_pages)
    reports = report.assemble(pages, "root")
    if reports.isEmpty():
        score = 100 if config.depth == 0 else 0
        return spark.createDataFrame([(url,)], "root string").select("root", F.array().cast(f"array<{report.PAGE}>").alias("pages"), F.lit(score).alias("site_score"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("crawled_at"))
    return reports


def bar(err=None):
    """Draws the progress on a terminal: pages done of those known."""
    err, done = err or sys.stderr, 0

    def draw(pages: list, total: int) -> None:
        nonlocal done
        done += len(pages)
        if err.isatty():
            err.write("\r" + report.progress_bar(done, max(done, total)))
            err.flush()

    return draw


def emit(reports: DataFrame, output: str | None, quiet: bool, colour: bool, out=None, err=None) -> None:
    """JSON to the file and text to stdout, or JSON to stdout and text to stderr; quiet: the score alone."""
    out, err = out or sys.stdout, err or sys.stderr
    row = reports.collect()[0]
    text = report.text_report(row, colour, quiet)
    if quiet and not output:
        out.write(text)
        return
    data = report.to_json(reports.sparkSession.createDataFrame([row], reports.schema)).collect()[0]["report"]
    if output:
        Path(output).write_text(data, encoding="utf-8")
        out.write(text)
    else:
        out.write(data + "\n")
        err.write(text)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "serve":
        from auditlake.server import serve

        serve(args.bind)
        return 0
    spark = get_spark(master=f"local[{getattr(args, 'concurrency', 4)}]")
    spark.sparkContext.setLogLevel("INFO" if getattr(args, "verbose", False) else "ERROR")
    colour = report.use_colour(args.no_color)
    if args.command == "audit":
        done = spark.createDataFrame(run_audit(spark, args.url, config_of(args), on_pages=None if args.quiet else bar()).collect(), report.REPORT)
        emit(done, args.output, args.quiet, colour)
        if args.history:
            history.record(done, args.history)
        return 0
    before, after = report.read_json(spark, args.before), report.read_json(spark, args.after)
    result = report.diff_reports(before, after)
    row = result.collect()[0]
    if row["before_root"] != row["after_root"]:
        print(f"warning: different roots: {row['before_root']} and {row['after_root']}", file=sys.stderr)
    if args.output == "json":
        print(result.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})).collect()[0][0])
    else:
        print(report.text_diff(row, colour), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
