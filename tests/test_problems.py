"""Nested records, neighbours, snapshot changes and balanced keys against brute force."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from auditlake.operators.balance import assign, balanced_join, pack, per_key, plan_load, replicate
from auditlake.operators.neighbours import with_neighbours
from auditlake.operators.nested import decode_reports, flatten_reports, report_items
from auditlake.operators.snapshots import SnapshotIndex, history_changes


def decoded(spark, *texts):
    return decode_reports(spark.createDataFrame(list(enumerate(texts)), "run_id long, report string"))


PAGE = {"url": "/", "score": "96", "findings": {"check_id": "x", "penalty": "5"}, "category_scores": [{"category": "M", "score": 1}, {"category": "N"}]}


def test_readable_reports(spark):
    body = json.dumps({"pages": [PAGE, None, 5, {"url": "b", "findings": [None, {"check_id": "y"}], "category_scores": {"L": "100", "K": None}}]})
    wrapped = [body, "﻿ " + body + "\n", json.dumps(body), json.dumps({"type": "Done", "report": json.loads(body)}), json.dumps({"type": "Done", "report": body}), json.dumps(json.dumps({"report": body}))]
    rows = Counter(tuple(r) for r in report_items(decoded(spark, *wrapped)).collect())
    one = [(0, "page", ""), (0, "finding", "0"), (0, "score", "M"), (3, "page", ""), (3, "finding", "1"), (3, "score", "L")]
    assert rows == Counter((i, *x) for i in range(len(wrapped)) for x in one)


def test_unreadable_reports(spark):
    bad = ['{"pages": [{"url": "a"', '{"pages": []} x', "", None, "null", '{"pages": null}', '{"pages": {"a": 1}}', "[]", "{'pages': []}", '"abc', '{"report": {"root": "x"}}', "7"]
    assert [r.pages for r in decoded(spark, *bad).collect()] == [None] * len(bad)
    assert decoded(spark, '{"pages": []}').collect()[0].pages == []
    long = json.dumps({"pages": [{"url": "x" * 300_000, "findings": [{"check_id": str(i)} for i in range(5000)]}]})
    assert report_items(decoded(spark, long)).count() == 5001


def test_reports_in_many_wraps_and_with_repeated_keys(spark):
    inner = json.dumps({"pages": [{"url": "a"}]})
    strings, envelopes = [inner], [json.loads(inner)]
    for _ in range(7):
        strings.append(json.dumps(strings[-1]))
        envelopes.append({"report": envelopes[-1]})
    broken = json.dumps(json.dumps(json.dumps(json.dumps(json.dumps({"report": '{"pages": [1'})))))
    texts = [*strings, *map(json.dumps, envelopes), '{"pages": [], "pages": [{"url": "x", "url": "a"}]}', broken]
    assert [r.pages and [p.url for p in r.pages] for r in decoded(spark, *texts).orderBy("run_id").collect()] == [["a"]] * 17 + [None]


def test_flat_tables_keep_links(spark):
    df = spark.createDataFrame([(7, "h", "r", 1, json.dumps({"pages": [PAGE]})), (8, None, "r", None, None)], "id long, host string, root_url string, site_score int, report string").withColumn("crawled_at", F.current_timestamp())
    t = flatten_reports(df)
    assert {(r.run_id, r.readable, r.n_pages) for r in t["runs"].collect()} == {(7, True, 1), (8, False, 0)}
    assert [tuple(r) for r in t["pages"].collect()] == [(7, 0, "/", 96)]
    f = t["findings"].collect()[0]
    assert (f.run_id, f.page_no, f.finding_no, f.check_id, f.penalty) == (7, 0, 0, "x", 5)
    assert [tuple(r) for r in t["scores"].collect()] == [(7, 0, "M", 1)]


def test_neighbours_across_partitions(spark):
    random.seed(3)
    rows = [(random.choice(["hot"] * 6 + ["b", "c", None]), i, i // 3) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, o long").withColumn("part", F.lit("clash"))
    want = {}
    for g in ("hot", "b", "c"):
        ks = sorted((o, k) for x, k, o in rows if x == g)
        for n, (_, k) in enumerate(ks):
            want[k] = (ks[n - 1][1] if n else None, ks[n + 1][1] if n + 1 < len(ks) else None)
    assert {r.k: (r.prev_key, r.next_key) for r in with_neighbours(df, "g", "k", ["o"]).collect()} == want
    assert with_neighbours(df.limit(0), "g", "k", ["o"]).count() == 0


def test_history_changes(spark):
    random.seed(4)
    rows, snaps = [], {}
    for s in range(6):
        state = {}
        for pos in range(25):
            url, score = random.choice("abcdefghij"), random.choice([1.0, 2.0, None])
            rows.append((s, url, score, pos))
            state[url] = score
        rows.append((s, None, 1.0, 99))
        snaps[s] = state
    df = spark.createDataFrame(rows, "snapshot_id long, url string, score double, pos int")
    steps = with_neighbours(spark.createDataFrame([("r", s) for s in snaps], "root string, snapshot_id long"), "root", "snapshot_id", [])
    want = set()
    for s in range(5):
        b, a = snaps[s], snaps[s + 1]
        for u in b.keys() | a.keys():
            if u not in b or u not in a or b[u] != a[u]:
                want.add((s, s + 1, u, "added" if u not in b else "removed" if u not in a else "changed", b.get(u), a.get(u)))
    got = history_changes(df, steps, ["url"], ["score"], fetch=True)
    assert {(r.before_id, r.after_id, r.url, r.change_kind, r.before_score, r.after_score) for r in got.collect()} == want
    assert history_changes(df.limit(0), steps, ["url"], ["score"]).count() == 0


def test_snapshot_index(spark, tmp_path):
    index = SnapshotIndex(spark, str(tmp_path / "i"), ["k"], ["v"], buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    kinds = lambda df: {(r.k, r.change_kind, r.before_v, r.after_v) for r in df.collect()}
    assert kinds(index.apply(frame([("a", 1), ("b", None), (None, 5)]))) == {("a", "added", None, 1), ("b", "added", None, None)}
    assert kinds(index.apply(frame([("a", 2), ("c", 3)]))) == {("a", "changed", 1, 2), ("b", "removed", None, None), ("c", "added", None, 3)}
    assert kinds(index.apply(frame([("a", 2), ("c", 3)]))) == set()
    assert kinds(index.apply(frame([]))) == {("a", "removed", 2, None), ("c", "removed", 3, None)}


def test_snapshot_index_sends_new_rows_only_and_survives_a_broken_run(spark, tmp_path):
    path = tmp_path / "i"
    index = SnapshotIndex(spark, str(path), ["k"], ["v"], buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    index.apply(frame([(f"k{i}", i) for i in range(50)]))
    (path / "v000000000002-broken" / "index").mkdir(parents=True)  # a run that ended before DONE
    assert {(r.k, r.change_kind) for r in index.apply(frame([(f"k{i}", i + (i == 7)) for i in range(49)])).collect()} == {("k7", "changed"), ("k49", "removed")}
    last = index._versions()[-1]
    schema = spark.createDataFrame([], "k string, state struct<h1:bigint,h2:bigint>").schema
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = index._changes(index._table(last, "index", schema), index._table(last, "index", schema))
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_history_sends_each_row_once(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0), (2, "a", 2.0, 0)], "snapshot_id long, url string, score double, pos int")
    steps = spark.createDataFrame([("r", 1, None, 2, 0), ("r", 2, 1, None, 1)], "root string, snapshot_id long, prev_key long, next_key long, place long")
    plan = history_changes(df, steps, ["url"], ["score"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_packing_spreads_heavy_keys():
    plan = pack([("big", 500), ("mid", 120)], 1000, 8)
    assert len(plan.heavy["big"][1]) == 4 and len(set(plan.heavy["big"][1])) == 4
    load = Counter()
    for n, at in plan.heavy.values():
        for t in at:
            load[t] += n / len(at)
    light = Counter(plan.light_tasks)
    assert all(load[t] + 380 * light[t] / sum(light.values()) < 1.3 * 1000 / 8 for t in range(8))


def test_planned_placement_is_kept(spark):
    rows = [(i, ["hot", "hot", "x", f"k{i % 90}"][i % 4]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string").withColumn("score", F.lit(1)).withColumn("at", F.col("id"))
    plan = plan_load(df, "k", 8)
    assert len(plan.heavy["khot"][1]) == 4
    side = df.select("k").distinct().withColumn("name", F.upper("k"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = balanced_join(df, side, "k", F.col("id"), plan)
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert text.count("hashpartitioning(__place") == 2 and text.count("Exchange hashpartitioning(") == 3  # the third is that of distinct()
        assert joined.where("name = upper(k)").count() == 4000
        counts = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(counts) == 8 and max(r["count"] for r in counts) < 1.5 * 4000 / 8
        text = per_key(df, "k", "id", "score", "at", plan)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(") == 2  # to the plan's tasks, and the shards' results by key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_balanced_results(spark):
    random.seed(5)
    rows = [(i, random.choices(["hot", "warm", "x", "y", "z", None], [50, 20, 9, 8, 8, 5])[0], random.choice([None, 1, 2, 9]), i // 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, score int, at long")
    plan = plan_load(df, "k", 8)
    sizes = [r["count"] for r in assign(df, "k", F.col("id"), plan).groupBy("__task").count().collect()]
    assert max(sizes) < 1.5 * 2000 / 8
    want = {}
    for k in ("hot", "warm", "x", "y", "z"):
        own = [r for r in rows if r[1] == k]
        scores = [r[2] for r in own if r[2] is not None]
        want[k] = (len(own), sum(scores) / len(scores), max(own, key=lambda r: (r[3], r[0]))[2])
    assert {r.k: (r.n, r.mean_score, r.latest_score) for r in per_key(df, "k", "id", "score", "at", plan).collect()} == want
    side = spark.createDataFrame([("hot", "H", "clash"), ("x", "X", "clash"), (None, "N", "c")], "k string, name string, score string")
    joined = balanced_join(df, side, "k", F.col("id"), plan).collect()
    assert len(joined) == 2000 and all(r.name == {"hot": "H", "x": "X"}.get(r.k) for r in joined)
    assert replicate(side.where("k = 'hot'"), "k", plan).count() == len(plan.heavy["khot"][1])
    none = plan_load(df.limit(0), "k", 4)
    assert per_key(df.limit(0), "k", "id", "score", "at", none).count() == 0
