"""Comparison, history, reports, streams, limits, the live source, command line and server."""

import datetime as dt
import http.client
import io
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from auditlake import cli
from auditlake.operators import diff, history, report
from auditlake.plans.audit import Config, audit
from auditlake.server import Admission, Jobs, make_server
from auditlake.sources.http import HttpSource, TokenBucket
from auditlake.streaming import limits, progress

CATS = ("Metadata", "SocialTags", "Structure", "Links", "Media", "Crawlability", "Security")


def write_report(path, score, pages):
    data = {"root": "https://a.example/", "site_score": score, "crawled_at": "2024-01-01T00:00:00Z", "pages": [{"url": u, "score": s, "findings": [], "category_scores": dict.fromkeys(CATS, s)} for u, s in pages]}
    path.write_text(json.dumps(data, indent=1))
    return str(path)


@pytest.fixture
def two_reports(tmp_path):
    before = write_report(tmp_path / "b.json", 65, [("/", 70), ("/about", 60), ("/removed", 50)])
    after = write_report(tmp_path / "a.json", 80, [("/", 70), ("/about", 85), ("/new", 90)])
    return before, after


def test_diff_of_reports(spark, two_reports):
    row = report.diff_reports(*(report.read_json(spark, p) for p in two_reports)).collect()[0]
    assert (row.before_site_score, row.after_site_score, row.site_score_delta) == (65, 80, 15)
    assert row.category_deltas == dict.fromkeys(CATS, 21)
    assert [(p.url, p.kind, p.before_score, p.after_score, p.delta) for p in row.pages] == [("/", "Unchanged", 70, 70, 0), ("/new", "Added", None, 90, 0), ("/removed", "Removed", 50, None, 0), ("/about", "Changed", 60, 85, 25)]
    text = report.text_diff(row)
    assert "65 → 80 (+15)" in text and "Improvements: 1" in text and "+25" in text


def test_bad_report_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"root": "a", "pages": [')
    with pytest.raises(Exception):
        report.read_json(spark, str(tmp_path / "x.json")).collect()


def test_diff_columns(spark):
    df = spark.createDataFrame([(3, "x" * 61), (-2, "y"), (0, None)], "d int, u string")
    assert [tuple(r) for r in df.select(diff.signed(F.col("d")), diff.short(F.col("u"))).collect()] == [("+3", "x" * 60 + "…"), ("-2", "y"), ("0", None)]
    b = spark.createDataFrame([("k", None), ("z", 1)], "url string, score int")
    a = spark.createDataFrame([("k", None), ("z", None)], "url string, score int")
    assert {r.url: (r.kind, r.delta) for r in diff.page_diff(b, a, ["url"]).collect()} == {"k": ("Unchanged", 0), "z": ("Changed", 0)}
    twice = spark.createDataFrame([("u", 0, 1), ("u", 1, 2)], "url string, pos int, score int")
    assert diff.last_entries(twice, ["url"], "pos", ["score"]).collect() == [("u", 2)]


def runs(spark, *rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, h, "r", s, None, t + dt.timedelta(days=d)) for i, (h, s, d) in enumerate(rows)], history.SCHEMA)


def test_regressions(spark):
    df = runs(spark, ("a", 90, 1), ("a", 80, 2), ("b", 90, 1), ("b", 92, 2), ("c", 90, 1), ("c", 85, 2), ("d", 1, 1), (None, 3, 1), ("a", None, 3))
    got = {r.host: (r.regressed, r.delta_points) for r in history.regressions(df, 5).collect()}
    assert got == {"a": (True, -10), "b": (False, 2), "c": (False, -5), "d": (False, None)}


def test_history_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    history.append(runs(spark, ("a", 1, 1), ("a", 2, 2), ("b", 3, 1)), path)
    history.append(runs(spark, ("a", 4, 9)), path)
    assert [r.site_score for r in history.newest(history.read(spark, path), "a", 2).collect()] == [4, 2]
    assert [history.limit_of(x) for x in (None, "x", "0", 500, "7")] == [20, 20, 1, 100, 7]
    assert [r.x for r in history.chart(history.read(spark, path)).orderBy("x").collect()] == [0.0, 300.0, 600.0]
    for value, want in (("0", 5), ("x", 5), ("9", 9)):
        monkeypatch.setenv("REGRESSION_THRESHOLD", value)
        assert history.threshold() == want


def test_text_report():
    page = {"url": "u" * 70, "score": 69, "findings": [{"severity": "Critical"}, {"severity": "Info"}], "category_scores": {"Media": 84}}
    text = report.text_report({"root": "r", "site_score": 69, "pages": [page]}, colour=True)
    assert "u" * 60 + "…" in text and "█" * 8 + "░" * 2 in text and "\x1b[31m" in text
    assert report.text_report({"root": "r", "site_score": 7, "pages": []}, quiet=True) == "7\n"


# --- streams and limits ----------------------------------------------------------------------


def brute_windows(rows, seconds, most):
    out, state = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start, n = state.get(k, (None, 0))
        if start is None or t - start >= seconds:
            start, n = t, 0
        state[k] = (start, n + 1)
        out[i] = n + 1 <= most
    return out


def test_fixed_windows(spark):
    import random

    random.seed(1)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, random.choice("aab"), random.randrange(400)) for i in range(120)]
    df = spark.createDataFrame([(i, k, base + dt.timedelta(seconds=t)) for i, k, t in rows] + [(999, None, base), (998, "a", None)], "id long, k string, t timestamp")
    got = {r.id: r.allowed for r in limits.fixed_windows(df, "k", "id", "t", 60, 5).collect()}
    assert got == brute_windows(rows, 60, 5)


def test_limit_stream(spark, tmp_path):
    spark.createDataFrame([("a", float(t)) for t in (0, 1, 2, 3, 4, 5, 61)], "k string, t double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t double").parquet(str(tmp_path / "in"))
    q = limits.limit_stream(stream, forget=False).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [r.allowed for r in spark.read.parquet(str(tmp_path / "out")).orderBy("t").collect()] == [True] * 5 + [False, True]


def test_grant_times(spark):
    import random

    random.seed(2)
    rows = sorted((round(random.uniform(0, 5), 3), i) for i in range(30))
    full, last, want = float("-inf"), float("-inf"), {}
    for n, (t, i) in enumerate(rows):
        due = max(t, full - (3 - 1) / 3 if n else t)
        full = max(t, full) + 1 / 3
        last = max(due, last + 0.4)
        want[i] = round(last, 6)
    df = spark.createDataFrame([("h", t, i) for t, i in rows], "host string, t double, id long")
    assert {r.id: round(r.granted, 6) for r in limits.grant_times(df, "host", "t", 3, 0.4, "id").collect()} == want


def test_token_bucket():
    now, waits = [0.0], []
    bucket = TokenBucket(2, clock=lambda: now[0], sleep=lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(10):
        bucket.acquire()
    assert sum(waits) == pytest.approx(4.0)
    bucket.set_interval(3)
    bucket.set_interval(1)
    before = now[0]
    bucket.acquire()
    assert now[0] - before == pytest.approx(3.0)


def test_progress_stream(spark, tmp_path):
    rows = [(1, "j", "u", 80), (1, "j", "u", 80), (2, "j", "v", 90), (3, None, None, None)]
    spark.createDataFrame(rows, "report_id long, job_id string, url string, score int").write.parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    progress.run_to_table(progress.job_counts(progress.read_stream(spark, str(tmp_path / "in"), like)), str(tmp_path / "t"), str(tmp_path / "c"))
    got = {r.job_id: r.pages_done for r in spark.read.parquet(progress.newest_version(spark, str(tmp_path / "t"))).collect()}
    assert got == {"j": 2, None: 1}
    assert progress.page_done(like).count() == 4


def test_events():
    events = [{"type": "Started", "job_id": "j", "seq": 0}, {"type": "PageDone", "seq": 1}]
    assert [e["type"] for e in progress.replay(events)] == ["Started", "PageDone"]
    assert [e["type"] for e in progress.replay([*events, {"type": "Done", "seq": 2}])] == ["Started", "Done"]
    text = progress.frame({"type": "Done", "n": 1}) + ": keep-alive\n\ndata: {bad\n\nevent: x"
    assert progress.parse_frames(text) == ([{"type": "Done", "n": 1}], "event: x")


def test_job_tables(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("a", t), ("b", t - dt.timedelta(seconds=601))], "job_id string, created_at timestamp")
    assert [r.job_id for r in progress.live_jobs(jobs, t).collect()] == ["a"]
    ev = spark.createDataFrame([("Started", "a", 0), ("Done", "a", 2), ("PageDone", "b", 1)], "type string, job_id string, seq int")
    assert {r.job_id: r.terminal for r in progress.terminal_state(ev).collect()} == {"a": "Done", "b": None}
    done = runs(spark, ("a", 1, 1)).withColumn("type", F.lit("Done")).unionByName(runs(spark, ("b", 2, 1)).withColumn("type", F.lit("Error")))
    progress.persist_done(str(tmp_path / "h"))(done, 0)
    assert [r.host for r in history.read(spark, str(tmp_path / "h")).collect()] == ["a"]


# --- the live web ----------------------------------------------------------------------------

PAGES = {
    "/": '<title>A root page with quite a good title here</title><h1>Root</h1><a href="/a">a</a><a href="/gone">g</a><a href="/private/x">p</a>',
    "/a": '<title>Page a</title><h1>A</h1><a href="/b">b</a>',
    "/b": "<title>Page b</title><h1>B</h1>",
    "/robots.txt": "User-agent: *\nDisallow: /private\nSitemap: /map.xml",
    "/map.xml": "<urlset><url><loc>http://{host}/a</loc></url></urlset>",
}


@pytest.fixture
def site():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            asked.append((self.command, self.path))
            if self.path == "/moved":
                self.send_response(301)
                self.send_header("Location", "/a")
                self.end_headers()
                return
            text = PAGES.get(self.path)
            self.send_response(200 if text is not None else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            if body and text is not None:
                self.wfile.write(text.replace("{host}", self.headers["Host"]).encode())

        def do_GET(self):  # noqa: N802
            self.answer(True)

        def do_HEAD(self):  # noqa: N802
            self.answer(False)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_source_reads(spark, site):
    spark.dataSource.register(HttpSource)
    rows = spark.read.format("audit_http").option("urls", f"{site[0]}/a\n{site[0]}/moved\n{site[0]}/none").option("rate", "50").load().collect()
    assert {(r.url.rsplit("/", 1)[1], r.status, r.location) for r in rows} == {("a", 200, None), ("moved", 301, "/a"), ("none", 404, None)}


def test_live_crawl(spark, site):
    root, asked = site
    seeds = spark.createDataFrame([("j", root + "/")], "job_id string, url string")
    from auditlake.sources.web import live

    pages = audit(seeds, live(rate=100), Config(depth=2)).collect()
    assert sorted((p.url.removeprefix(root), p.depth) for p in pages) == [("/", 0), ("/a", 1), ("/b", 2), ("/gone", 1)]
    ids = {f.check_id for p in pages for f in p.findings}
    assert {"https.insecure", "links.broken-4xx", "title.short"} <= ids and "robots.missing" not in ids and "sitemap.missing" not in ids
    assert ("GET", "/private/x") not in asked


def test_command_line(spark, site, tmp_path, two_reports, capsys):
    args = cli.parser().parse_args(["audit", site[0] + "/b", "-d", "0", "--rate", "0", "-o", str(tmp_path / "r.json")])
    config = cli.config_of(args)
    assert config.rate == 1 and args.concurrency == 8
    reports = cli.run_audit(spark, args.url, Config(depth=0, rate=100))
    out = io.StringIO()
    cli.emit(reports, args.output, False, False, out, out)
    data = json.loads((tmp_path / "r.json").read_text())
    assert data["root"] == site[0] + "/b" and len(data["pages"]) == 1 and "Site score" in out.getvalue()
    out = io.StringIO()
    cli.emit(reports, None, True, False, out, out)
    assert out.getvalue() == f"{data['site_score']}\n"
    level = spark.sparkContext
    assert cli.main(["diff", *two_reports, "-f", "json"]) == 0 and level
    assert json.loads(capsys.readouterr().out)["site_score_delta"] == 15
    blocked = cli.run_audit(spark, site[0] + "/private/x", Config(depth=0, rate=100)).collect()[0]
    assert (blocked.site_score, blocked.pages) == (100, [])


def test_admission():
    now = [0.0]
    a = Admission(True, most=2, seconds=60, active=3, clock=lambda: now[0])
    assert [a.admit("x", 0) for _ in range(3)] == [True, True, False] and a.admit("y", 0) and not a.admit("z", 3)
    now[0] = 60.0
    assert a.admit("x", 0) and all(Admission(False).admit("x", 99) for _ in range(9))


def test_history_answer(spark):
    got = history.answer(runs(spark, ("a", 90, 1), ("a", 80, 2), ("b", 1, 1)), "a", "1")
    assert [r["site_score"] for r in got["runs"]] == [80] and got["regression"] == {"regressed": True, "delta_points": -10}
    assert history.answer(runs(spark, ("a", 90, 1)), "zz")["regression"] == {"regressed": False, "delta_points": None}
    assert report.progress_bar(1, 2, 4) == "[==  ] 1/2" and report.progress_bar(0, 0, 2) == "[==] 0/0"


def test_server():
    server = make_server("127.0.0.1:0", Jobs(lambda root, config: {"root": root, "pages": [{"url": root, "score": 90}], "site_score": 90}, history=lambda host, limit: {"host": host, "limit": limit}))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        c = http.client.HTTPConnection("127.0.0.1", server.server_port, timeout=10)
        c.request(method, path, body and json.dumps(body))
        r = c.getresponse()
        return r.status, r.read().decode()

    assert ask("GET", "/healthz")[0] == 200
    status, body = ask("POST", "/api/audits", {"url": "https://a.example/"})
    assert status == 202
    events, _ = progress.parse_frames(ask("GET", f"/api/audits/{json.loads(body)['job_id']}/events")[1])
    assert events[0]["type"] == "Started" and events[-1]["type"] == "Done"
    time.sleep(0.2)
    late, _ = progress.parse_frames(ask("GET", f"/api/audits/{json.loads(body)['job_id']}/events")[1])
    assert [e["type"] for e in late] == ["Started", "Done"]
    assert ask("POST", "/api/audits", {"url": "::"})[0] == 500 and ask("GET", "/api/audits/x/events")[0] == 404
    assert json.loads(ask("GET", "/api/history?host=a.example&limit=3")[1]) == {"host": "a.example", "limit": "3"} and ask("GET", "/api/history")[0] == 400
    server.shutdown()
