"""Limits, deadlines and progress against a server on this machine."""

import http.client
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from auditlake import cli
from auditlake.operators import history
from auditlake.plans.audit import Config, audit
from auditlake.server import Jobs, make_server
from auditlake.sources.web import live
from auditlake.streaming import progress

ROBOTS = "User-agent: *\nCrawl-delay: 0.6\n"


@pytest.fixture
def site():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append((time.time(), self.command, self.path))
            if self.path.startswith("/slow"):
                time.sleep(0.3)
            body = ROBOTS if self.path == "/robots.txt" else '<html><title>t</title><a href="/a">a</a><a href="/b">b</a></html>'
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body.encode())

        do_HEAD = do_GET  # noqa: N815

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_crawl_delay_spaces_a_hosts_pages(spark, site):
    root, asked = site
    seeds = spark.createDataFrame([("j", root + "/")], "job_id string, url string")
    assert audit(seeds, live(rate=100), Config(depth=1)).count() == 3
    pages = sorted(t for t, method, path in asked if method == "GET" and path in ("/a", "/b"))
    assert len(pages) == 2 and pages[1] - pages[0] >= 0.55


def test_limits_outlive_a_call(spark, site):
    root, asked = site
    web = live(rate=1)
    for path in ("/x", "/y", "/z"):
        assert web(spark.createDataFrame([(f"{root}{path}",)], "url string"), "GET").count() == 1
    times = sorted(t for t, _, path in asked if path in ("/x", "/y", "/z"))
    assert all(b - a >= 0.9 for a, b in zip(times, times[1:], strict=False))


def test_deadline_cuts_a_running_level(spark, site):
    root, asked = site
    urls = spark.createDataFrame([(f"{root}/slow{i}",) for i in range(40)], "url string")
    live(rate=1000)(urls.limit(1), "GET").count()  # workers are up
    began = len(asked)
    got = live(rate=1000, deadline=time.time() + 2.5)(urls, "GET").collect()
    errors = [r for r in got if r.error == "Deadline"]
    assert len(got) == 40 and errors and len(asked) - began < 40


def test_server_tells_pages_as_they_are_done_and_keeps_the_run(spark, site, tmp_path):
    root, _ = site
    table = str(tmp_path / "history")
    history.create(spark, table)
    assert history.read(spark, table).count() == 0
    gates = []

    def run(url, config, page_done):
        assert config.concurrency == 2

        def seen(pages, total):
            page_done(pages, total)
            gates.append(len(pages))

        return cli.run_audit(spark, url, config, live(config.concurrency, rate=100), seen).collect()[0].asDict(recursive=True)

    jobs = Jobs(run, keep=lambda r: history.record(spark.createDataFrame([r], cli.report.REPORT), table))
    server = make_server("127.0.0.1:0", jobs)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = http.client.HTTPConnection("127.0.0.1", server.server_port, timeout=120)
    c.request("POST", "/api/audits", json.dumps({"url": root + "/", "depth": 1, "concurrency": 2}))
    job = json.loads(c.getresponse().read())["job_id"]
    c.request("GET", f"/api/audits/{job}/events")
    events, _ = progress.parse_frames(c.getresponse().read().decode())
    assert [e["type"] for e in events] == ["Started", "PageDone", "PageDone", "PageDone", "Done"] and gates == [1, 2]
    assert [e["queue_depth"] for e in events[1:4]] == [0, 1, 0]
    kept = history.read(spark, table).collect()
    assert [(r.root_url, r.host, r.site_score) for r in kept] == [(root + "/", root.removeprefix("http://"), events[-1]["report"]["site_score"])]
    server.shutdown()


def test_history_that_fails_is_not_the_jobs_failure():
    jobs = Jobs(lambda root, config: {"pages": [], "site_score": 1}, keep=lambda r: 1 / 0)
    job = jobs.start("https://a.example/", Config())
    for _ in range(100):
        if job.terminal:
            break
        time.sleep(0.02)
    assert job.terminal["type"] == "Done"


def test_command_line_takes_a_frontier_address_and_shows_progress(capsys):
    args = cli.parser().parse_args(["audit", "https://a.example/", "--redis-url", "redis://x", "-c", "3"])
    assert args.redis_url == "redis://x" and cli.config_of(args).concurrency == 3

    class Terminal:
        text = ""

        def isatty(self):
            return True

        def write(self, s):
            self.text += s

        def flush(self):
            pass

    t = Terminal()
    draw = cli.bar(t)
    draw([1, 2], 5)
    draw([3], 5)
    assert t.text.split("\r")[-1].endswith("3/5")


def test_a_hot_host_gets_the_bucket_s_times(spark):
    import random

    from auditlake.sources.http import TokenBucket
    from auditlake.streaming.limits import grant_times

    rng = random.Random(4)
    rows = [(i, "hot" if rng.random() < 0.8 else f"h{i % 7}", round(rng.random() * 300, 3)) for i in range(1500)]
    want = {}
    for host in {h for _, h, _ in rows}:
        now = [0.0]
        bucket = TokenBucket(2, 0.7, clock=lambda now=now: now[0], sleep=lambda s: None)
        for i, _, t in sorted((r for r in rows if r[1] == host), key=lambda r: (r[2], r[0])):
            now[0] = t
            want[i] = bucket.acquire()
    df = spark.createDataFrame(rows, "i long, host string, t double")
    got = {r.i: r.granted for r in grant_times(df, "host", "t", 2, 0.7, "i").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_endless_streams_forget_old_keys(spark, tmp_path):
    rows = [(1, "j", 50, "2024-01-01 00:00:00"), (1, "j", 50, "2024-01-01 00:10:00"), (2, "j", 70, "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "report_id long, job_id string, score int, received_at string").selectExpr("report_id", "job_id", "score", "cast(received_at as timestamp) received_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = progress.read_stream(spark, str(tmp_path / "in"), df)
    counts = progress.job_counts(stream, late="1 hour")
    progress.run_to_table(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(progress.newest_version(spark, str(tmp_path / "out"))).collect()
    assert [(r.job_id, r.pages_done, r.mean_score) for r in got] == [("j", 2, 60.0)]
