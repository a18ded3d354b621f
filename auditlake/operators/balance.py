"""Per-key work where a few keys hold most rows: fragment and replicate by estimated load.

Loads are estimated by a frequent-items sketch, one per task, merged. Keys beyond a task's fair share are
split into shards in proportion to their load, shards and the rest are bin-packed onto tasks, rows move once,
to the task that the plan names, and a matching side is replicated to exactly the shards of its key.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import parallelism

#: A key is split when its load exceeds this part of one task's fair share.
FAIR_PART = 0.5


@dataclass(frozen=True)
class Plan:
    """``heavy``: key, total rows, and the task of each of its shards; light keys go to ``light_tasks``."""

    tasks: int
    total: int
    heavy: dict[str, tuple[int, list[int]]]
    light_tasks: list[int]


def pack(heavy: list[tuple[str, int]], total: int, tasks: int) -> Plan:
    """Longest-processing-time bin packing of the heavy keys' shards; light rows fill what is left.

    A light slot is a hash range of the keys that are not split; each task gets slots in proportion to the
    room its shards leave.
    """
    share = max(1.0, total / tasks)
    bins = [(0.0, t) for t in range(tasks)]
    heapq.heapify(bins)
    placed: dict[str, tuple[int, list[int]]] = {}
    shards = sorted(((n / math.ceil(n / share), k, math.ceil(n / share), n) for k, n in heavy), reverse=True)
    for size, key, count, n in shards:
        at = []
        for _ in range(count):
            load, t = heapq.heappop(bins)
            heapq.heappush(bins, (load + size, t))
            at.append(t)
        placed[key] = (n, at)
    room = {t: max(0.0, share - load) for load, t in bins}
    free = sum(room.values())
    slots = [t for t, r in sorted(room.items()) for _ in range(round(r / free * 8 * tasks) if free else 0)]
    return Plan(tasks, total, placed, slots or list(range(tasks)))


#: Keys that the sketch tracks for each key that may be heavy; its error is about rows / tracked.
TRACKED = 16


def plan_load(rows: DataFrame, key: str, tasks: int | None = None) -> Plan:
    """Estimate the heavy keys' loads and plan their tasks; an estimate that is off moves work, not results.

    Only keys above ``FAIR_PART`` of a task's share come to the driver: fewer than tasks / FAIR_PART
    of them can exist, whatever the data. Null is a key of its own here (as the string null marker).
    """
    tasks = tasks or parallelism(rows.sparkSession)
    most = math.ceil(tasks / FAIR_PART) + 1
    sketch = F.expr(f"approx_top_k(k, {most}, {min(1_000_000, most * TRACKED)})")
    seen = rows.select(_text(F.col(key)).alias("k")).agg(sketch.alias("top"), F.count("*").alias("n")).collect()[0]
    floor = max(1, math.ceil(seen["n"] / tasks * FAIR_PART))
    return pack([(r["item"], r["count"]) for r in seen["top"] if r["count"] >= floor], seen["n"], tasks)


_places: dict[int, list[int]] = {}


def places(spark: SparkSession, tasks: int) -> list[int]:
    """For each task the least number that hash partitioning into ``tasks`` sends to it.

    A column of these makes the plan's placement one that joins and aggregations recognise and keep.
    """
    if tasks not in _places:
        at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("t")
        found = {r["t"]: r["p"] for r in spark.range(40 * tasks + 400).select("id", at).groupBy("t").agg(F.min("id").alias("p")).collect()}
        _places[tasks] = [found[t] for t in range(tasks)]
    return _places[tasks]


def moved(df: DataFrame, plan: Plan) -> DataFrame:
    """Rows at the tasks that ``__task`` names; ``__place`` stands for it from here on."""
    at = F.array(*[F.lit(p) for p in places(df.sparkSession, plan.tasks)])
    return df.withColumn("__place", F.element_at(at, F.col("__task") + 1)).drop("__task").repartition(plan.tasks, "__place")


def _text(c: Column) -> Column:
    """Key as text; null gets a marker that no other key has, as keys are prefixed."""
    return F.when(c.isNull(), "n").otherwise(F.concat(F.lit("k"), c.cast("string")))


def _with_tasks(df: DataFrame, key: str, plan: Plan) -> DataFrame:
    """Add ``__at``: the tasks of a heavy key's shards, else null.

    The heavy keys are broadcast: there are fewer than tasks / FAIR_PART of them, whatever the data.
    """
    if not plan.heavy:
        return df.withColumn("__at", F.lit(None).cast("array<int>"))
    heavy = df.sparkSession.createDataFrame([(k, at) for k, (_, at) in plan.heavy.items()], "__k string, __at array<int>")
    return df.withColumn("__k", _text(F.col(key))).join(F.broadcast(heavy), "__k", "left").drop("__k")


def _light(key: str, plan: Plan) -> Column:
    """Task of a key that is not split."""
    slots = F.array(*[F.lit(t) for t in plan.light_tasks])
    return F.element_at(slots, (F.pmod(F.xxhash64(_text(F.col(key))), F.lit(len(plan.light_tasks))) + 1).cast("int"))


def assign(rows: DataFrame, key: str, spread: Column, plan: Plan) -> DataFrame:
    """Add ``__shard`` and ``__task``; ``spread`` (any evenly hashed column) picks a heavy key's shard."""
    df = _with_tasks(rows, key, plan)
    df = df.withColumn("__shard", F.when(F.col("__at").isNotNull(), F.pmod(F.xxhash64(spread), F.size("__at"))).otherwise(0).cast("int"))
    return df.withColumn("__task", F.when(F.col("__at").isNotNull(), F.element_at("__at", F.col("__shard") + 1)).otherwise(_light(key, plan))).drop("__at")


def replicate(side: DataFrame, key: str, plan: Plan) -> DataFrame:
    """The matching side: one copy for a light key, one for each shard of a heavy key."""
    df = _with_tasks(side, key, plan)
    return df.select(*side.columns, F.posexplode(F.coalesce("__at", F.array(_light(key, plan)))).alias("__shard", "__task"))


def balanced_join(facts: DataFrame, side: DataFrame, key: str, spread: Column, plan: Plan, how: str = "left") -> DataFrame:
    """Equi join on ``key`` in which each task gets its planned load. ``how``: inner or left.

    Either side moves once, to the planned tasks, and is joined there. Null keys match nothing. Other
    columns that both sides share keep the facts' values.
    """
    f = moved(assign(facts, key, spread, plan), plan)
    clash = [c for c in side.columns if c in facts.columns and c != key]
    s = moved(replicate(side.drop(*clash), key, plan), plan)
    return f.join(s, ["__place", key, "__shard"], how).drop("__place", "__shard").select(*facts.columns, *[c for c in side.columns if c not in facts.columns])


def per_key(rows: DataFrame, key: str, row_id: str, score: str, at: str, plan: Plan) -> DataFrame:
    """(key, n, mean_score, latest_score) of every key.

    Rows: one per ``row_id``. The mean leaves null scores out (null if there are none); the latest score
    is that of the row with the greatest (at, row_id), which may be null. A null key is left out. Rows move
    once, to the planned tasks, where each shard is aggregated; then the few shard results of a key are merged.
    """
    placed = moved(assign(rows.where(F.col(key).isNotNull()), key, F.col(row_id), plan), plan)
    part = placed.groupBy("__place", key, "__shard").agg(F.count("*").alias("n"), F.sum(F.col(score).cast("bigint")).alias("s"), F.count(score).alias("c"), F.max(F.struct(at, row_id, score)).alias("last"))
    whole = part.groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.max("last").alias("last"))
    return whole.select(key, "n", F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("mean_score"), F.col(f"last.{score}").alias("latest_score"))
