"""Audits over HTTP: POST /api/audits, GET /api/audits/<id>/events (server-sent events), GET /healthz."""

from __future__ import annotations

import inspect
import json
import os
import sys
import threading
import time
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

from auditlake.functions import urls
from auditlake.plans.audit import Config
from auditlake.streaming.limits import MOST, SECONDS
from auditlake.streaming.progress import JOB_TTL, frame

#: Seconds without an event after which a comment keeps the connection open.
KEEP_ALIVE = 15
#: Audits that may run at once under protection.
MAX_ACTIVE = 3


class Job:
    def __init__(self, root: str):
        self.id, self.root, self.created = uuid.uuid4().hex, root, time.time()
        self.events: list[dict] = []
        self.changed = threading.Condition()

    def send(self, event: dict) -> None:
        with self.changed:
            self.events.append(event)
            self.changed.notify_all()

    @property
    def terminal(self) -> dict | None:
        return next((e for e in reversed(self.events) if e["type"] in ("Done", "Error")), None)


class Admission:
    """Fixed windows per client and a cap on running jobs; without protection all pass."""

    def __init__(self, protect: bool | None = None, most: int = MOST, seconds: float = SECONDS, active: int = MAX_ACTIVE, clock: Callable[[], float] = time.monotonic):
        self.protect = os.environ.get("LIVE_DEMO_RATE_LIMIT_PROTECTION", "").lower() in ("1", "true") if protect is None else protect
        self.most, self.seconds, self.active, self.clock = most, seconds, active, clock
        self.windows: dict[str, tuple[float, int]] = {}

    def admit(self, client: str, running: int) -> bool:
        if not self.protect:
            return True
        now = self.clock()
        self.windows = {k: w for k, w in self.windows.items() if now - w[0] < self.seconds}
        start, n = self.windows.get(client, (now, 0))
        if n >= self.most or running >= self.active:
            return False
        self.windows[client] = (start, n + 1)
        return True


class Jobs:
    """Running and finished jobs; those older than the time to live are dropped when others come.

    ``run`` gets the root, the options and, if it takes a third value, a function for the (url, score) of pages
    as they are done and the number of URLs known; else its pages are sent at its end. ``history``, if given, answers (host, limit) with the newest runs of the host and its
    regression; ``keep`` stores each finished report, and its failure is not the job's.
    """

    def __init__(self, run: Callable[[str, Config, Callable], dict], ttl: float = JOB_TTL, admission: Admission | None = None, history: Callable[[str, str | None], dict] | None = None, keep: Callable[[dict], None] | None = None):
        self.run, self.ttl, self.known = run, ttl, {}
        self.admission, self.history, self.keep = admission or Admission(), history, keep

    @property
    def running(self) -> int:
        return sum(j.terminal is None for j in self.known.values())

    def start(self, root: str, config: Config) -> Job:
        now = time.time()
        self.known = {k: j for k, j in self.known.items() if now - j.created < self.ttl}
        job = Job(root)
        self.known[job.id] = job
        threading.Thread(target=self._work, args=(job, config), daemon=True).start()
        return job

    def _work(self, job: Job, config: Config) -> None:
        job.send({"type": "Started", "job_id": job.id, "root": job.root})
        done = 0

        def page_done(pages: list, total: int = 0) -> None:
            nonlocal done
            for p in pages:
                done += 1
                job.send({"type": "PageDone", "job_id": job.id, "url": p["url"], "score": p["score"], "queue_depth": max(0, total - done), "pages_done": done})

        try:
            watched = len(inspect.signature(self.run).parameters) > 2
            result = self.run(job.root, config, page_done) if watched else self.run(job.root, config)
            if not watched:
                page_done(result["pages"])
            if self.keep:
                try:
                    self.keep(result)
                except Exception as e:  # noqa: BLE001 - a run is reported even if it can't be stored
                    print(f"history: {str(e)[:500]}", file=sys.stderr)
            job.send({"type": "Done", "job_id": job.id, "report": result})
        except Exception as e:  # noqa: BLE001 - reported to the client
            job.send({"type": "Error", "job_id": job.id, "message": str(e)[:500]})


def handler(jobs: Jobs) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _json(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:  # noqa: ANN002
            pass

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/api/audits":
                return self._json(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                if not urls.parse(body["url"]):
                    raise ValueError("the URL can't be read")
                config = Config(depth=int(body.get("depth", 1)), max_pages=body.get("max_pages"), concurrency=int(body["concurrency"]) if body.get("concurrency") else None)
            except (ValueError, KeyError, TypeError) as e:
                return self._json(500, {"error": str(e)})
            if not jobs.admission.admit(self.client_address[0], jobs.running):
                return self._json(429, {"error": "too many audits"})
            return self._json(202, {"job_id": jobs.start(body["url"], config).id})

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/healthz":
                return self._json(200, {"status": "ok"})
            path, _, query = self.path.partition("?")
            if path == "/api/history" and jobs.history:
                asked = parse_qs(query)
                if not asked.get("host"):
                    return self._json(400, {"error": "host is missing"})
                return self._json(200, jobs.history(asked["host"][0], asked.get("limit", [None])[0]))
            parts = path.strip("/").split("/")
            job = jobs.known.get(parts[2]) if len(parts) == 4 and parts[:2] == ["api", "audits"] and parts[3] == "events" else None
            if job is None:
                return self._json(404, {"error": "no such job"})
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(frame({"type": "Started", "job_id": job.id, "root": job.root}).encode())
            if job.terminal:  # a late subscriber gets the end at once
                self.wfile.write(frame(job.terminal).encode())
                return None
            sent = 0
            while True:
                with job.changed:
                    if sent >= len(job.events):
                        job.changed.wait(KEEP_ALIVE)
                    fresh, sent = job.events[sent:], len(job.events)
                self.wfile.write(("".join(frame(e) for e in fresh if e["type"] != "Started") or ": keep-alive\n\n").encode())
                self.wfile.flush()
                if any(e["type"] in ("Done", "Error") for e in fresh):
                    return None

    return Handler


def make_server(bind: str, jobs: Jobs) -> ThreadingHTTPServer:
    host, _, port = bind.rpartition(":")
    return ThreadingHTTPServer((host, int(port)), handler(jobs))


def serve(bind: str) -> None:
    from auditlake.cli import run_audit
    from auditlake.operators import history, report
    from auditlake.session import get_spark

    spark = get_spark()

    def run(root: str, config: Config, page_done: Callable) -> dict:
        return run_audit(spark, root, config, on_pages=page_done).collect()[0].asDict(recursive=True)

    table = os.environ.get("AUDIT_HISTORY")
    if table:
        history.create(spark, table)

    def past(host: str, limit: str | None) -> dict:
        return history.answer(history.read(spark, table), host, limit)

    def keep(result: dict) -> None:
        history.record(spark.createDataFrame([result], report.REPORT), table)

    make_server(bind, Jobs(run, history=past if table else None, keep=keep if table else None)).serve_forever()
