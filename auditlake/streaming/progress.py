"""Progress of jobs as a stream of events, and what late subscribers see.

A slow subscriber loses nothing: the server keeps a job's events and sends on from where the subscriber
is, and streaming queries hold their source back, so there is no lag to report.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Jobs older than this many seconds are dropped.
JOB_TTL = 600


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The files at ``path`` (a folder or a file) as a stream with the schema of ``like``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(like.schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return stream.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return stream.parquet(path)


def page_done(reports: DataFrame) -> DataFrame:
    """One PageDone event per report: type, job_id, url, score, queue_depth."""
    return reports.select(F.lit("PageDone").alias("type"), "job_id", "url", "score", F.lit(0).cast("bigint").alias("queue_depth"))


def job_counts(reports: DataFrame, key: str = "report_id", late: str | None = None, at: str = "received_at") -> DataFrame:
    """Running (job_id, pages_done, mean_score); a repeated ``key`` counts once. Batch or stream.

    An endless stream needs ``late``, such as "7 days": how far apart by ``at`` the copies of a row may come.
    Keys older than that are forgotten; without it every key is kept, which suits a stream that ends.
    """
    once = reports.dropDuplicates([key]) if late is None else reports.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy("job_id").agg(F.count("*").alias("pages_done"), F.avg("score").alias("mean_score"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Run the stream over all that is there and keep the newest result at ``path``, as complete tables."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def newest_version(spark: SparkSession, path: str) -> str:
    """Folder of the last version ``run_to_table`` wrote."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return max((str(s.getPath().toString()) for s in found), key=lambda s: int(s.rsplit("/v", 1)[1]))


def terminal_state(events: DataFrame) -> DataFrame:
    """(job_id, started, terminal): what a late subscriber is told per job.

    ``terminal`` is the last Done or Error event, null while the job runs. Events: type, job_id, seq, ...
    """
    last = F.max(F.when(F.col("type").isin("Done", "Error"), F.struct("seq", "type")))
    return events.where("job_id IS NOT NULL").groupBy("job_id").agg(F.min("seq").alias("started"), last["type"].alias("terminal"))


def replay(events: list[dict]) -> Iterator[dict]:
    """Frames of one job for a subscriber: Started first; a stored terminal event ends it at once."""
    ordered = sorted(events, key=lambda e: e["seq"])
    end = next((e for e in reversed(ordered) if e["type"] in ("Done", "Error")), None)
    yield {"type": "Started"} | ({k: ordered[0][k] for k in ("job_id",)} if ordered else {})
    if end:
        yield end
    else:
        yield from (e for e in ordered if e["type"] != "Started")


def frame(event: dict) -> str:
    """A server-sent event."""
    return f"event: {event['type']}\ndata: {json.dumps(event, default=str)}\n\n"


def parse_frames(text: str) -> tuple[list[dict], str]:
    """Complete events of a buffer and what is left of it; comments and unreadable data are skipped."""
    *whole, rest = text.replace("\r\n", "\n").split("\n\n")
    out = []
    for block in whole:
        data = "\n".join(line[5:].lstrip() for line in block.split("\n") if line.startswith("data:"))
        if data:
            try:
                out.append(json.loads(data))
            except ValueError:
                continue
    return out, rest


def live_jobs(jobs: DataFrame, now, ttl: int = JOB_TTL) -> DataFrame:
    """Jobs created within the last ``ttl`` seconds before ``now`` (a timestamp)."""
    return jobs.where(F.col("created_at") >= F.lit(now) - F.make_interval(secs=F.lit(ttl)))


def persist_done(history_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends the report of each Done event to the history table.

    Events: type, id, host, root_url, site_score, report, crawled_at.
    """
    from auditlake.operators import history

    def write(batch: DataFrame, _: int) -> None:
        history.append(batch.where("type = 'Done'"), history_path)

    return write
