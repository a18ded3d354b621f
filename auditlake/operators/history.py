"""History of runs: append, newest runs of a host, regressions, chart points."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id bigint, host string, root_url string, site_score int, report string, crawled_at timestamp"
DEFAULT_LIMIT, MOST = 20, 100


def limit_of(text: str | int | None) -> int:
    """A limit from 1 to 100; 20 where it is no number."""
    try:
        return max(1, min(MOST, int(str(text).strip())))
    except ValueError:
        return DEFAULT_LIMIT


def threshold() -> int:
    """REGRESSION_THRESHOLD, 5 where it is unset, no number or 0."""
    try:
        return int(os.environ.get("REGRESSION_THRESHOLD", "5")) or 5
    except ValueError:
        return 5


def append(runs: DataFrame, path: str) -> None:
    """Add runs to the history table at ``path``, partitioned by host; creates it if needed."""
    runs.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").partitionBy("host").parquet(path)


def create(spark: SparkSession, path: str) -> None:
    """An empty history table at ``path`` unless there is one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.mkdirs(p)


def record(reports: DataFrame, path: str) -> None:
    """Add finished reports (root, pages, site_score, crawled_at) as runs; the id is the time in microseconds.

    The host includes the port. Failures are left to the caller.
    """
    at = F.to_timestamp("crawled_at")
    body = F.to_json(F.struct("root", "pages", "site_score", "crawled_at"), {"ignoreNullFields": "false"})
    host = F.regexp_extract("root", r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#]*)", 1)
    append(reports.select(F.unix_micros(F.coalesce(at, F.current_timestamp())).alias("id"), host.alias("host"), F.col("root").alias("root_url"), "site_score", body.alias("report"), F.coalesce(at, F.current_timestamp()).alias("crawled_at")), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The history table; a filter on host reads only that host's files."""
    return spark.read.schema(SCHEMA).parquet(path)


def newest(runs: DataFrame, host: str, limit: str | int | None = None) -> DataFrame:
    """The newest runs of one host, newest first: a distributed top-k."""
    return runs.where(F.col("host") == host).orderBy(F.desc("crawled_at"), F.desc("id")).limit(limit_of(limit))


def newest_per_host(runs: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest runs of every host with their place (1: newest).

    Spark cuts each task's rows to the first ``n`` of a host before the shuffle (window group limit), so
    a host with a third of all runs is cut down where its rows lie.
    """
    w = Window.partitionBy("host").orderBy(F.desc("crawled_at"), F.desc("id"))
    return runs.where(F.col("host").isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def regressions(runs: DataFrame, least: int | None = None) -> DataFrame:
    """(host, newest_score, previous_score, delta_points, regressed) of every host.

    Regressed if the newest score is lower than the one before by more than the threshold; false with
    fewer than two scored runs (then delta is null). Runs without a score are left out.
    """
    last = newest_per_host(runs.where(F.col("site_score").isNotNull()), 2)
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("site_score")))
    two = last.groupBy("host").agg(at(1).alias("newest_score"), at(2).alias("previous_score"))
    delta = F.col("newest_score") - F.col("previous_score")
    t = threshold() if least is None else least
    return two.withColumn("delta_points", delta).withColumn("regressed", F.coalesce(delta < -t, F.lit(False)))


def answer(runs: DataFrame, host: str, limit: str | int | None = None) -> dict:
    """The newest runs of a host (at most 100) and whether its score fell, as plain values."""
    last = newest(runs, host, limit).select("id", "root_url", "site_score", F.col("crawled_at").cast("string").alias("crawled_at")).collect()
    fell = regressions(runs.where(F.col("host") == host)).collect()
    return {"runs": [r.asDict() for r in last], "regression": {"regressed": bool(fell and fell[0]["regressed"]), "delta_points": fell[0]["delta_points"] if fell else None}}


def chart(runs: DataFrame, n: int = DEFAULT_LIMIT, width: float = 600.0, height: float = 160.0) -> DataFrame:
    """Points of each host's chart, oldest first: (host, id, crawled_at, site_score, x, y); two runs at least."""
    last = newest_per_host(runs.where(F.col("site_score").isNotNull()), n)
    count = last.groupBy("host").agg(F.max("place").alias("points")).where("points >= 2")
    i = F.col("points") - F.col("place")
    x: Column = i * width / (F.col("points") - 1)
    y: Column = height - F.col("site_score") * height / 100
    return last.join(count, "host").select("host", "id", "crawled_at", "site_score", x.alias("x"), y.alias("y"))
