"""What changed between consecutive full snapshots.

A snapshot is indexed as key -> hash of the values, in buckets of keys. New rows probe the index of the
snapshot before; values are fetched only where hashes differ; then the new index takes the old one's
place. ``history_changes`` runs many series of snapshots through indexes held by its tasks, each a bucket,
in one pass; ``SnapshotIndex`` keeps the index of one series as bucketed files for snapshots as they arrive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import _remove, broadcast_if_small, materialize, parallelism


def state_hash(*values: Column) -> Column:
    """Hash of a row's values in which null differs from any value and 0.0 equals -0.0."""
    parts = [x for v in values for x in (v.isNull(), v)]
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *reversed(parts)).alias("h2"))


def change_kind(before: Column, after: Column) -> Column:
    return F.when(before.isNull(), "added").when(after.isNull(), "removed").otherwise("changed")


class BucketIndex:
    """One bucket's index of the last snapshot of a series: key -> hash of its values.

    ``probe`` compares the next snapshot's entries with the index and swaps it; it returns (before, after,
    key, kind). Snapshots without a key in this bucket are known by their neighbours' links alone.
    """

    def __init__(self) -> None:
        self.id: int | None = None
        self.next: int | None = None
        self.held: dict = {}

    def leave(self, upto: int | None) -> list[tuple]:
        """Changes of the step after the indexed snapshot, unless ``upto`` is that step's snapshot."""
        if self.id is None or self.next is None or self.next == upto:
            return []
        out = [(self.id, self.next, k, "removed") for k in self.held]
        self.id, self.held = None, {}
        return out

    def probe(self, snapshot: int, before: int | None, after: int | None, entries: dict) -> list[tuple]:
        out = self.leave(snapshot)
        old = self.held if self.id is not None and self.id == before else {}
        if before is not None:
            for k, state in entries.items():
                was = old.get(k)
                if was is None:
                    out.append((before, snapshot, k, "added"))
                elif was != state:
                    out.append((before, snapshot, k, "changed"))
            out += [(before, snapshot, k, "removed") for k in old if k not in entries]
        self.id, self.next, self.held = snapshot, after, entries
        return out


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run one bucket's rows, sorted by series, snapshot and position, through its index."""
    index, now, links, entries = BucketIndex(), None, (None, None), {}

    def out(found: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), key_type, pa.string()), strict=True)], names=["before_id", "after_id", "key", "change_kind"])

    key_type = None
    for b in batches:
        key_type = b.column("key").type
        states = zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), strict=True)
        keys = b.column("key")
        named = keys.to_pylist() if not pa.types.is_struct(key_type) else [tuple(k.values()) for k in keys.to_pylist()]
        found: list[tuple] = []
        for snapshot, before, after, key, state in zip(b.column("snapshot_id").to_pylist(), b.column("prev_key").to_pylist(), b.column("next_key").to_pylist(), named, states, strict=True):
            if snapshot != now:
                if now is not None:
                    found += index.probe(now, *links, entries)
                now, links, entries = snapshot, (before, after), {}
            entries[key] = state
        yield out(found, key_type)
    if now is not None:
        yield out(index.probe(now, *links, entries) + index.leave(None), key_type)


def history_changes(rows: DataFrame, steps: DataFrame, keys: list[str], values: list[str], fetch: bool = False) -> DataFrame:
    """Changes between neighbouring snapshots of many series.

    ``rows``: snapshot_id, ``keys``, ``values``, ``pos``; where a snapshot lists a key twice the row with
    the larger ``pos`` counts; rows with a null key are no keys and are left out. ``steps``: series,
    snapshot_id, prev_key, next_key, place (see ``with_neighbours``). Result: before_id, after_id, keys,
    change_kind and, with ``fetch``, before_<value> and after_<value>.

    Each row is sent once, as key and hash, to the bucket of its series and key, so neither a long series
    nor a large snapshot gathers in one task; a task holds the part of one snapshot that is in its bucket.
    Values are fetched for changes only.
    """
    known = rows
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    series = next(c for c in steps.columns if c not in ("snapshot_id", "prev_key", "next_key", "place"))
    links = steps.select(F.xxhash64(series).alias("series"), "snapshot_id", "prev_key", "next_key", "place")
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    hashed = known.select("snapshot_id", *keys, key.alias("key"), "pos", state_hash(*[F.col(v) for v in values]).alias("s")).select("snapshot_id", *keys, "key", "pos", "s.h1", "s.h2")
    sent = hashed.join(broadcast_if_small(links), "snapshot_id").repartition(parallelism(rows.sparkSession), "series", *keys)
    probed = sent.sortWithinPartitions("place", "pos").select("snapshot_id", "prev_key", "next_key", "key", "h1", "h2")
    found = probed.mapInArrow(_probed, f"before_id bigint, after_id bigint, key {hashed.schema['key'].dataType.simpleString()}, change_kind string")
    found = found.select("before_id", "after_id", *([F.col("key").alias(keys[0])] if len(keys) == 1 else [F.col(f"key.{k}").alias(k) for k in keys]), "change_kind")
    if fetch:
        found = materialize(found, "changes")
        ends = found.select(F.explode(F.array("before_id", "after_id")).alias("snapshot_id"), *keys).distinct()
        latest = known.join(broadcast_if_small(ends), ["snapshot_id", *keys], "left_semi").groupBy("snapshot_id", *keys).agg(F.max(F.struct("pos", *values)).alias("r"))
        latest = materialize(latest, "changed")
        for side in ("before", "after"):
            old = latest.select(F.col("snapshot_id").alias(f"{side}_id"), *keys, *[F.col(f"r.{v}").alias(f"{side}_{v}") for v in values])
            found = found.join(old, [f"{side}_id", *keys], "left")
    return found


class SnapshotIndex:
    """Key-to-hash index of the last snapshot, kept as a bucketed table; values are kept beside it.

    ``apply(snapshot)`` returns the changes and swaps the index: the new version is written under a new
    name, and an empty file DONE, created last, puts it in force, so a failed run leaves the old index in
    force. Only the new rows are sent to their buckets; the old index and its values are read bucket by
    bucket where they lie. Nulls in keys are left out; repeated keys keep the row with the larger ``pos``
    column if there is one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.values, self.buckets = spark, path.rstrip("/"), keys, values, buckets

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        """Names of finished versions, oldest first."""
        p, fs = self._files(self.path)
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        return [n for n in names if fs.exists(self._files(f"{self.path}/{n}/DONE")[0])]

    def _table(self, version: str, part: str, schema) -> DataFrame:
        """The bucketed files of a version, known to this session's catalog."""
        name = f"auditlake_{part}_{uuid.uuid4().hex}"
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{version}/{part}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, version: str, part: str) -> None:
        name = f"auditlake_{part}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.path}/{version}/{part}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay, as the table is external

    def _changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Keys whose hashes differ; ``old`` lies in buckets already."""
        both = old.withColumnRenamed("state", "b").join(new.withColumnRenamed("state", "a"), self.keys, "full_outer")
        return both.where(~F.col("b").eqNullSafe(F.col("a"))).select(*self.keys, change_kind(F.col("b"), F.col("a")).alias("change_kind"))

    def apply(self, snapshot: DataFrame) -> DataFrame:
        rows = snapshot
        for k in self.keys:
            rows = rows.where(F.col(k).isNotNull())
        order = F.col("pos") if "pos" in rows.columns else F.lit(0)
        rows = rows.groupBy(*self.keys).agg(F.max(F.struct(order.alias("pos"), *self.values)).alias("r")).select(*self.keys, "r.*").drop("pos")
        rows = rows.repartition(self.buckets, *self.keys)
        values, index = rows.select(*self.keys, *self.values), rows.select(*self.keys, state_hash(*[F.col(v) for v in self.values]).alias("state"))
        done = self._versions()
        version = f"v{int(done[-1][1:13]) + 1 if done else 1:012d}-{uuid.uuid4().hex}"
        self._write(values, version, "values")
        now = self._table(version, "values", values.schema)
        self._write(now.select(*self.keys, state_hash(*[F.col(v) for v in self.values]).alias("state")), version, "index")
        new = self._table(version, "index", index.schema)
        old = self._table(done[-1], "index", index.schema) if done else new.limit(0)
        changes = materialize(self._changes(old, new), "changes")
        for side, kept in (("before", self._table(done[-1], "values", values.schema) if done else now.limit(0)), ("after", now)):
            changes = changes.join(kept.select(*self.keys, *[F.col(v).alias(f"{side}_{v}") for v in self.values]), self.keys, "left")
        changes.write.parquet(f"{self.path}/{version}/changes")
        p, fs = self._files(f"{self.path}/{version}/DONE")
        fs.create(p, False).close()
        for name in done:
            _remove(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(changes.schema).parquet(f"{self.path}/{version}/changes")
