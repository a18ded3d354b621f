"""How often every distinct term occurs, and in how many records: heavy-light aggregation.

Heavy terms (few, by definition) are found by lossy counting in one pass and broadcast; each task then
counts them in exact local arrays while it scans. Only the other terms are shuffled. Two things an array
can't know alone, rows that are repeated elsewhere and records that lie in several tasks, are settled on
packed columns of ids and term numbers: one small compressed block per task and bucket of records. Both
tables are united.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize, parallelism

#: A term is heavy from this share of all values of its field: at most 1 / HEAVY per field.
HEAVY = 0.001
#: Entries that lossy counting keeps per task and field.
KEPT = 4096
#: Rows that one task packs or unpacks at once; more rows make more blocks, more rows in all more buckets.
PACKED, BUCKET_ROWS = 2_000_000, 1_000_000


def normal(c: Column) -> Column:
    """Value without surrounding white space and in lower case; blank becomes null."""
    t = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(t != "", t)


def _lossy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates for heavy values of each column: an upper bound of each kept value's count."""
    held: dict[str, Counter] = {}
    floor: dict[str, int] = {}
    rows = 0
    for b in batches:
        rows += b.num_rows
        for name, col in zip(b.schema.names, b.columns, strict=True):
            c = held.setdefault(name, Counter())
            for v in pc.value_counts(pc.cast(col.drop_null(), pa.string())).to_pylist():
                c[v["values"]] += v["counts"]
            if len(c) > 2 * KEPT:
                kept = dict(c.most_common(KEPT))
                floor[name] = floor.get(name, 0) + c.most_common(KEPT + 1)[-1][1]
                held[name] = Counter(kept)
    names = [n for n, c in held.items() for _ in c]
    yield pa.RecordBatch.from_arrays(
        [pa.array([*names, ""], pa.string()), pa.array([*[v for c in held.values() for v in c], ""], pa.string()), pa.array([*[k + floor.get(n, 0) for n, c in held.items() for k in c.values()], rows], pa.int64())],
        names=["field", "term", "n"],
    )


def heavy_values(rows: DataFrame, share: dict[str, float]) -> tuple[dict[str, list[str]], int]:
    """Values whose share of the rows may reach ``share[field]``, by field, and the number of rows.

    The result is bounded by 1 / share plus what lossy counting can't rule out; whatever it names or
    misses, counts stay exact, as it only decides which way a value goes.
    """
    seen = materialize(rows.select(*share).mapInArrow(_lossy, "field string, term string, n bigint").groupBy("field", "term").agg(F.sum("n").alias("n")), "candidates")
    total = int(seen.where("field = ''").agg(F.sum("n")).collect()[0][0] or 0)
    out: dict[str, list[str]] = {f: [] for f in share}
    limit = F.lit(False)
    for f, s in share.items():
        limit = limit | ((F.col("field") == f) & (F.col("n") >= max(2.0, s * total)))
    for r in seen.where(limit).select("field", "term").toLocalIterator():
        out[r["field"]].append(r["term"])
    return out, total


# --- packed blocks -----------------------------------------------------------------------------


def _delta(a: pa.Array) -> pa.Array:
    """Whole numbers as steps, which compress well; other types stay."""
    if not pa.types.is_integer(a.type):
        return a
    n = a.to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        return pa.array(np.diff(n, prepend=n.dtype.type(0)), a.type)


def _summed(a: pa.Array) -> pa.Array:
    if not pa.types.is_integer(a.type):
        return a
    with np.errstate(over="ignore"):
        return pa.array(np.cumsum(a.to_numpy(zero_copy_only=False), dtype=a.type.to_pandas_dtype()), a.type)


def packed(t: pa.Table) -> bytes:
    """A table sorted by record and item as one compressed block."""
    cols = [_delta(c.combine_chunks()) if name in ("record", "item") else c.combine_chunks() for name, c in zip(t.column_names, t.columns, strict=True)]
    sink = pa.BufferOutputStream()
    t = pa.table(cols, names=t.column_names)
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    t = pa.ipc.open_stream(block).read_all()
    return pa.table([_summed(c.combine_chunks()) if name in ("record", "item") else c for name, c in zip(t.column_names, t.columns, strict=True)], names=t.column_names)


SCANNED = "field string, term string, n bigint, bucket int, block binary"
COUNTED = "field string, term string, n_items bigint, n_records bigint, record string"


def _number(col: pa.Array, terms: pa.Array) -> pa.Array:
    """Number of each heavy term from 1 on, in the smallest type; 0 for other values and nulls."""
    kind = np.uint8 if len(terms) < 255 else np.uint16 if len(terms) < 65_535 else np.uint32
    return pa.array((pc.fill_null(pc.index_in(col, terms), -1).to_numpy(zero_copy_only=False) + 1).astype(kind))


def _same(t: pa.Table, names: list[str]) -> np.ndarray:
    """Whether each row of a sorted table equals the one before in ``names``."""
    same = np.ones(t.num_rows, bool)
    same[:1] = False
    for n in names:
        c = t.column(n).combine_chunks()
        same[1:] &= pc.equal(c.slice(1), c.slice(0, max(0, len(c) - 1))).to_numpy(zero_copy_only=False)
    return same


def _scan(fields: list[str], heavy):
    """Count heavy terms of a task's rows in local arrays, pack ids and term numbers, hand on light terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {f: pa.array(heavy.value[f], pa.string()) for f in fields}
        items = {f: np.zeros(len(terms[f]), np.int64) for f in fields}

        def rows(k: int, field, term, n, bucket, block) -> pa.RecordBatch:
            cols = [(field, pa.string()), (term, pa.string()), (n, pa.int64()), (bucket, pa.int32()), (block, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.nulls(k, t) if v is None else pa.array(v, t) for v, t in cols], names=["field", "term", "n", "bucket", "block"])

        def blocks(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.sort_by([("bucket", "ascending"), ("record", "ascending"), ("item", "ascending")]).combine_chunks()
            t = t.filter(pa.array(~_same(t, ["bucket", "record", "item"])))  # rows repeated in this task
            numbers = {f: _number(t.column(f).combine_chunks(), terms[f]) for f in fields}
            for f in fields:
                items[f] += np.bincount(numbers[f].to_numpy(zero_copy_only=False), minlength=len(terms[f]) + 1)[1:]
            light = {f: pc.and_(pc.equal(numbers[f], 0), pc.is_valid(t.column(f).combine_chunks())) for f in fields}
            at = np.r_[0, np.nonzero(np.diff(t.column("bucket").to_numpy()))[0] + 1, t.num_rows]
            slim = pa.table({"record": t.column("record"), "item": t.column("item")} | numbers)
            yield rows(len(at) - 1, None, None, None, t.column("bucket").to_numpy()[at[:-1]], [packed(slim.slice(a, b - a)) for a, b in zip(at[:-1], at[1:], strict=True)])
            for f in fields:
                some = t.filter(light[f])
                if some.num_rows:  # packed like the rest, a block for each bucket of terms
                    own = pa.table({"bucket": some.column(f"{f}_bucket"), "term": some.column(f), "record": some.column("record"), "item": some.column("item")})
                    own = own.sort_by([("bucket", "ascending"), ("term", "ascending"), ("record", "ascending"), ("item", "ascending")]).combine_chunks()
                    bucket = own.column("bucket").to_numpy()
                    at = np.r_[0, np.nonzero(np.diff(bucket))[0] + 1, own.num_rows]
                    yield rows(len(at) - 1, [f] * (len(at) - 1), None, None, bucket[at[:-1]], [packed(own.drop_columns("bucket").slice(a, b - a)) for a, b in zip(at[:-1], at[1:], strict=True)])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= PACKED:
                yield from blocks(pa.Table.from_batches(held))
                held = []
        if any(h.num_rows for h in held):
            yield from blocks(pa.Table.from_batches(held))
        for f in fields:
            if items[f].any():
                k = len(terms[f])
                yield rows(k, [f] * k, terms[f], items[f], None, None)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Table]]]:
    """Blocks of one bucket after another; a partition is sorted by bucket."""
    now, blocks = None, []
    for b in batches:
        for bucket, block in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
            if bucket != now and blocks:
                yield now, blocks
                blocks = []
            now = bucket
            blocks.append(unpacked(block))
    if blocks:
        yield now, blocks


def _settle(fields: list[str], heavy, hot):
    """From packed blocks: rows repeated across tasks (to take off) and records of each heavy term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {f: heavy.value[f] for f in fields}
        hot_records = pa.array(hot.value, pa.string())
        extra = {f: np.zeros(len(terms[f]), np.int64) for f in fields}
        records = {f: np.zeros(len(terms[f]), np.int64) for f in fields}
        total, pairs = 0, []
        for _, blocks in _joined(batches):
            t = pa.concat_tables(blocks).sort_by([("record", "ascending"), ("item", "ascending")]).combine_chunks()
            again = _same(t, ["record", "item"])
            for f in fields:
                extra[f] += np.bincount(t.column(f).to_numpy()[again], minlength=len(terms[f]) + 1)[1:]
            t = t.filter(pa.array(~again))
            first = ~_same(t, ["record"])
            rid = np.cumsum(first) - 1
            one = t.column("record").combine_chunks().filter(pa.array(first))
            is_hot = pc.is_in(pc.cast(one, pa.string()), hot_records).to_numpy(zero_copy_only=False)
            total += int((~is_hot).sum())
            pairs += [("", "", r) for r in pc.cast(one.filter(pa.array(is_hot)), pa.string()).to_pylist()]
            for f in fields:
                size = len(terms[f]) + 1
                known = np.unique(rid * size + t.column(f).to_numpy().astype(np.int64))
                known = known[known % size > 0]
                calm = ~is_hot[known // size]
                records[f] += np.bincount(known[calm] % size, minlength=size)[1:]
                pairs += [(f, terms[f][k % size - 1], str(one[int(k // size)].as_py())) for k in known[~calm].tolist()]
        out = [("", "", 0, total, None)] + [(f, x, -int(e), int(r), None) for f in fields for x, e, r in zip(terms[f], extra[f], records[f], strict=True) if e or r] + [(f, x, 0, 0, r) for f, x, r in pairs]
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["field", "term", "n_items", "n_records", "record"])

    return run


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact counts of the light terms of each bucket of terms."""
    for (field, _), blocks in _joined_by_field(batches):
        t = pa.concat_tables(blocks).sort_by([("term", "ascending"), ("record", "ascending"), ("item", "ascending")]).combine_chunks()
        t = t.filter(pa.array(~_same(t, ["term", "record", "item"])))
        new_term, new_record = ~_same(t, ["term"]), ~_same(t, ["term", "record"])
        at = np.nonzero(new_term)[0]
        items = np.diff(np.r_[at, t.num_rows])
        records = np.add.reduceat(new_record.astype(np.int64), at)
        k = len(at)
        yield pa.RecordBatch.from_arrays([pa.array([field] * k, pa.string()), t.column("term").combine_chunks().filter(pa.array(new_term)), pa.array(items), pa.array(records), pa.nulls(k, pa.string())], names=["field", "term", "n_items", "n_records", "record"])


def _joined_by_field(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[pa.Table]]]:
    now, blocks = None, []
    for b in batches:
        for field, bucket, block in zip(b.column("field").to_pylist(), b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
            if (field, bucket) != now and blocks:
                yield now, blocks
                blocks = []
            now = field, bucket
            blocks.append(unpacked(block))
    if blocks:
        yield now, blocks


def term_frequencies(rows: DataFrame, record: str, item: str, fields: list[str], heavy: float = HEAVY) -> tuple[DataFrame, int]:
    """(field, term, n_items, n_records) of every term, and the number of distinct records.

    Each ``item`` counts once, though its row may be repeated; every item belongs to one record. Null
    and blank values are no terms; a row with a null item or record is left out. Heavy terms are counted
    where their rows are read. A record that holds a large part of all rows is spread over buckets by
    item, and only its (term, record) pairs are made distinct by a further shuffle.
    """
    spark = rows.sparkSession
    parts = parallelism(spark)
    clean = rows.where(F.col(item).isNotNull() & F.col(record).isNotNull()).select(F.col(record).alias("record"), F.col(item).alias("item"), *[normal(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)])
    names = [f"f{i}" for i in range(len(fields))]
    found, n = heavy_values(clean, {**{f: heavy for f in names}, "record": max(0.5 / parts, 0.002)})
    sc = spark.sparkContext
    terms, hot = sc.broadcast({f: sorted(found[f]) for f in names}), sc.broadcast(sorted(found["record"]))
    buckets = max(parts, -(-n // BUCKET_ROWS))
    salt = F.when(F.col("record").cast("string").isin(hot.value), F.xxhash64("item")).otherwise(0) if hot.value else F.lit(0)
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    keyed = clean.select("*", place("record", salt).alias("bucket"), *[place(f).alias(f"{f}_bucket") for f in names])
    scanned = materialize(keyed.mapInArrow(_scan(names, terms), SCANNED), "scan")
    sums = [F.sum("n_items").alias("n_items"), F.sum("n_records").alias("n_records")]
    settled = scanned.where("field is null").select("bucket", "block").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(names, terms, hot), COUNTED)
    light = scanned.where("field is not null and block is not null").select("field", "bucket", "block").repartition(buckets, "field", "bucket").sortWithinPartitions("field", "bucket").mapInArrow(_light, COUNTED)
    settled = materialize(settled.unionByName(light), "terms")
    total = settled.where("field = ''").agg(F.sum("n_records") + F.count_distinct("record")).collect()[0][0] or 0
    body = settled.where("field <> ''")
    out = scanned.where("block is null").select("field", "term", F.col("n").alias("n_items"), F.lit(0).cast("bigint").alias("n_records")).unionByName(body.where("record is null").drop("record"))
    if hot.value:
        more = body.where("record is not null").select("field", "term", "record").distinct().groupBy("field", "term").agg(F.lit(0).cast("bigint").alias("n_items"), F.count("*").alias("n_records"))
        out = out.unionByName(more)
    named = F.element_at(F.array(*[F.lit(f) for f in fields]), F.substring("field", 2, 9).cast("int") + 1)
    return out.groupBy("field", "term").agg(*sums).where("n_items > 0").withColumn("field", named), int(total)


def mark(terms: DataFrame, records: int, rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """Add ``mark``: rare below ``rare_below`` records, common above that share of them, else null."""
    n = F.col("n_records")
    return terms.withColumn("mark", F.when(n < rare_below, "rare").when(n > F.lit(common_above) * F.lit(records), "common"))
