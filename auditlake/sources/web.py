"""One interface to a recording and to the live web: a function of URLs and a method.

``web(urls, method)`` takes a frame with the column url (and perhaps delay) and returns recorded responses (see ``recorded``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import host_of
from auditlake.session import broadcast_if_small, materialize, parallelism
from auditlake.sources import http

Web = Callable[[DataFrame, str], DataFrame]

_TYPES = pa.schema(
    [("method", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("location", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("error", pa.string()), ("attempt", pa.int32())]
)


def recording(responses: DataFrame) -> Web:
    """Responses that were recorded before; URLs without a record have none."""
    if "attempt" not in responses.columns:
        responses = responses.withColumn("attempt", F.lit(0))

    def web(_: DataFrame, method: str) -> DataFrame:
        return responses.where(F.col("method") == method)

    return web


#: Columns beside ``http.SCHEMA`` that carry a host's limits from one call to the next.
LIMITS = "host string, full_at double, last double"


def live(concurrency: int | None = None, **options: str) -> Web:
    """The web itself: one task per group of hosts, so limits per host hold; each URL is asked once.

    A host's limits outlive batches and calls: where its bucket stood after a call is written beside the
    responses and goes to the next call's task of that host. A column delay is the host's least interval.
    ``concurrency``: tasks at once at most.
    """
    states: list[DataFrame] = []

    def web(urls: DataFrame, method: str) -> DataFrame:
        o = {k: str(v) for k, v in options.items()} | {"method": method}
        spark = urls.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            limits: dict[str, http.TokenBucket] = {}
            rate, interval = float(o.get("rate", "2")), float(o.get("delay", "0"))
            for b in batches:
                for host, full_at, last in zip(b.column("host").to_pylist(), b.column("full_at").to_pylist(), b.column("last").to_pylist(), strict=True):
                    if host not in limits and last is not None:
                        limits[host] = http.TokenBucket(rate, interval, full_at=full_at, last=last)
                for row in http.fetch_all(b.column("url").to_pylist(), o, limits, b.column("delay").to_pylist()):
                    cols = [pa.array([list(v.items()) if isinstance(v, dict) else v], t) for v, t in zip(row, _TYPES.types, strict=True)]
                    host = host_of(row[1]) or ""
                    mine = limits[host]
                    more = [pa.array([host]), pa.array([mine.full_at]), pa.array([mine.last])]
                    yield pa.RecordBatch.from_arrays([*cols, *more], names=[*_TYPES.names, "host", "full_at", "last"])

        host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))
        delay = F.col("delay").cast("double") if "delay" in urls.columns else F.lit(None).cast("double")
        asked = urls.where("url IS NOT NULL").groupBy("url").agg(F.max(delay).alias("delay")).withColumn("host", host)
        if states:
            known = states[0]
            for s in states[1:]:
                known = known.unionByName(s)
            asked = asked.join(broadcast_if_small(known.groupBy("host").agg(F.max("full_at").alias("full_at"), F.max("last").alias("last"))), "host", "left")
        else:
            asked = asked.withColumns({"full_at": F.lit(None).cast("double"), "last": F.lit(None).cast("double")})
        tasks = min(parallelism(spark), concurrency or parallelism(spark))
        got = materialize(asked.repartition(tasks, "host").sortWithinPartitions("host", "url").mapInArrow(run, f"{http.SCHEMA}, {LIMITS}"), "web")
        states.append(got.where("last > 0").select("host", "full_at", "last"))
        return got.drop("host", "full_at", "last")

    return web


def as_web(source: DataFrame | Web) -> Web:
    return recording(source) if isinstance(source, DataFrame) else source
