"""Previous and next row of each row within its group, without a task per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize, parallelism


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link rows of one sorted partition; ``head`` and ``tail`` mark its first and last row."""
    part, last, held, seen = TaskContext.get().partitionId(), None, None, 0

    def out(b: pa.RecordBatch, final: bool) -> pa.RecordBatch:
        n = b.num_rows
        tail = pa.array([False] * (n - 1) + [final])
        return pa.RecordBatch.from_arrays([*b.columns, tail], names=[*b.schema.names, "tail"])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        group, key = b.column("group_key"), b.column("row_key")
        prior_g = pa.concat_arrays([pa.array([last[0] if last else None], group.type), group.slice(0, n - 1)])
        prior_k = pa.concat_arrays([pa.array([last[1] if last else None], key.type), key.slice(0, n - 1)])
        same = pc.fill_null(pc.equal(prior_g, group), False)
        prev = pc.if_else(same, prior_k, pa.scalar(None, key.type))
        if held is not None:
            yield out(held, False)
        place = pa.array(np.arange(seen, seen + n) + (part << 40))
        held = pa.RecordBatch.from_arrays([group, key, prev, pa.array([part] * n, pa.int32()), place, pa.array([last is None] + [False] * (n - 1))], names=["group_key", "row_key", "prev_key", "part", "place", "head"])
        seen += n
        last = (group[-1].as_py(), key[-1].as_py())
    if held is not None:
        yield out(held, True)


def with_neighbours(rows: DataFrame, group: str, key: str, order: list[str]) -> DataFrame:
    """(group, key, prev_key, next_key, place) with a unique bigint ``key``, ordered by ``order``, then ``key``.

    ``place`` is a number that sorts all rows by group and order.

    Rows are range-partitioned on group and order, so a group that holds a third of all rows spreads
    over as many tasks as its share. Only the first and last row of each partition, at most two
    per partition, pass through the driver to link across borders. Null groups are dropped; ties in
    ``order`` are broken by ``key``; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    cols = [F.col(group).alias("group_key"), F.col(key).cast("bigint").alias("row_key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]]
    by = ["group_key", *[f"o{i}" for i in range(len(order))], "row_key"]
    ranged = rows.where(F.col(group).isNotNull()).select(*cols).repartitionByRange(parallelism(spark), *by).sortWithinPartitions(*by)
    linked = materialize(ranged.select("group_key", "row_key").mapInArrow(_link, "group_key string, row_key bigint, prev_key bigint, part int, place bigint, head boolean, tail boolean"), "neighbours")
    ends = sorted(linked.where("head or tail").collect(), key=lambda r: (r["part"], not r["head"]))
    fix, before = [], None
    for e in ends:
        if e["head"] and before is not None and before["group_key"] == e["group_key"]:
            fix.append((e["row_key"], before["row_key"]))
        if e["tail"]:
            before = e
    patch = spark.createDataFrame(fix, "row_key bigint, across bigint")
    prev = linked.join(F.broadcast(patch), "row_key", "left").select("group_key", "row_key", F.coalesce("prev_key", "across").alias("prev_key"), "place")
    follow = prev.where("prev_key is not null").select(F.col("prev_key").alias("row_key"), F.col("row_key").alias("next_key"))
    return prev.join(follow, "row_key", "left").select(F.col("group_key").alias(group), F.col("row_key").alias(key), "prev_key", "next_key", "place")
