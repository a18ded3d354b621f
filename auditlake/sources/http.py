"""The live web as a Python data source: one partition per bucket of hosts, polite within each.

    spark.dataSource.register(HttpSource)
    spark.read.format("audit_http").option("urls", "https://a.example/\\nhttps://b.example/").load()

Rows have the columns of recorded responses for GET and HEAD, with redirects not followed, so that
``recorded.fetch`` and ``links.probe`` run on them unchanged. Options: urls (one per line), method, rate
(requests a second and host), delay (least seconds between requests), timeout, user_agent, buckets.
"""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auditlake import __version__
from auditlake.functions import urls
from auditlake.sources.recorded import MAX_RETRIES, headers_of

USER_AGENT = f"auditlake/{__version__} (+https://auditlake.example)"
SCHEMA = "method string, url string, status int, location string, headers map<string,string>, body binary, error string, attempt int"


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):  # noqa: ANN002, ANN201
        return None


class TokenBucket:
    """Per host: ``rate`` requests a second with a burst of as many, and a least interval."""

    def __init__(self, rate: float, interval: float = 0.0, clock=time.time, sleep=time.sleep, full_at: float = float("-inf"), last: float = float("-inf")):
        self.rate, self.interval, self.clock, self.sleep = max(1.0, rate), interval, clock, sleep
        self.full_at, self.last = full_at, last

    def acquire(self) -> float:
        now = self.clock()
        due = max(now, self.full_at - (self.rate - 1) / self.rate, self.last + self.interval)
        if due > now:
            self.sleep(due - now)
        self.full_at = max(due, self.full_at) + 1 / self.rate
        self.last = due
        return due

    def set_interval(self, seconds: float) -> None:
        """Never shrinks."""
        self.interval = max(self.interval, seconds)


def request(url: str, method: str, timeout: float, user_agent: str) -> tuple:
    """(status, location, headers, body, error) of one request without redirects."""
    opener = urllib.request.build_opener(_NoRedirect)
    try:
        with opener.open(urllib.request.Request(url, method=method, headers={"User-Agent": user_agent}), timeout=timeout) as r:
            return r.status, r.headers.get("Location"), headers_of(r.headers.items()), r.read(), None
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Location"), headers_of(e.headers.items()), e.read(), None
    except (OSError, ValueError, http.client.HTTPException) as e:
        return None, None, {}, None, f"{type(e).__name__}: {e}"


class _Bucket(InputPartition):
    def __init__(self, targets: list[str]):
        self.targets = targets


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        n = int(self.o.get("buckets", "32"))
        by: dict[int, list[str]] = {}
        for u in dict.fromkeys(x.strip() for x in self.o.get("urls", "").splitlines() if x.strip()):
            by.setdefault(crc32((urls.host_of(u) or "").encode()) % n, []).append(u)
        return [_Bucket(t) for _, t in sorted(by.items())] or [_Bucket([])]

    def read(self, partition: _Bucket) -> Iterator[tuple]:
        return fetch_all(partition.targets, self.o)


def fetch_all(targets: list[str], o: dict, limits: dict[str, TokenBucket] | None = None, delays: list[float | None] | None = None) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for each URL: one after the other, within each host's limits, with retries of GET.

    ``limits`` keeps the hosts' buckets between calls; ``delays`` are least intervals that a host asks for.
    After the option deadline (seconds since the epoch) nothing is asked any more: error "Deadline".
    """
    method = o.get("method", "GET").upper()
    timeout, agent = float(o.get("timeout", "30")), o.get("user_agent", USER_AGENT)
    deadline = float(o.get("deadline", "inf"))
    limits = {} if limits is None else limits
    for u, delay in zip(targets, delays or [None] * len(targets), strict=True):
        host = urls.host_of(u) or ""
        if host not in limits:
            limits[host] = TokenBucket(float(o.get("rate", "2")), float(o.get("delay", "0")))
        bucket = limits[host]
        bucket.set_interval(delay or 0.0)
        for attempt in range(MAX_RETRIES + 1):
            if time.time() < deadline:
                bucket.acquire()
            if time.time() >= deadline:
                yield (method, u, None, None, {}, None, "Deadline", attempt)
                break
            status, location, headers, body, error = request(u, method, min(timeout, max(0.1, deadline - time.time())), agent)
            yield (method, u, status, location, headers, body, error, attempt)
            if method != "GET" or status not in (429, 503) or attempt == MAX_RETRIES:
                break
            after = headers.get("retry-after", "")
            time.sleep(min(int(after) if after.isdigit() else 2**attempt, max(0.0, deadline - time.time())))


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audit_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)
