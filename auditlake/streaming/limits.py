"""Rate limits: fixed windows per key, spaced requests per host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlake.session import broadcast_if_small, materialize, parallelism

#: Requests that a window admits, and its length in seconds.
MOST, SECONDS = 5, 60


def _windows(length: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor, count, number = None, 0.0, 0, 0
        for b in batches:
            out = ([], [], [])
            for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True):
                if k != key:
                    key, anchor, count, number = k, t, 0, 1
                elif t - anchor >= length * 1e6:
                    anchor, count, number = t, 0, number + 1
                count += 1
                for c, v in zip(out, (number, count, count <= most), strict=True):
                    c.append(v)
            cols = [b.column("k"), b.column("id"), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_()), strict=True)]]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "id", "window_no", "n_in_window", "allowed"])

    return run


def fixed_windows(requests: DataFrame, key: str, row_id: str, at: str, seconds: float = SECONDS, most: int = MOST) -> DataFrame:
    """(key, row_id, window_no, n_in_window, allowed): windows begin at a key's first request.

    After ``seconds`` the next request begins a new window; the first ``most`` of each pass. The rule is
    sequential per key, so rows are sorted by key and time in each partition and read as a stream with
    three numbers of state, whatever the size of a key. Null keys and times are left out; ties go by id.
    """
    rows = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(row_id).cast("bigint").alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    placed = rows.repartition("k").sortWithinPartitions("k", "t", "id").mapInArrow(_windows(seconds, most), "k string, id bigint, window_no bigint, n_in_window bigint, allowed boolean")
    return placed.withColumnsRenamed({"k": key, "id": row_id})


LIMITED = "k string, t double, n_in_window long, allowed boolean"


def _admit(seconds: float, most: int, forget: bool):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        out = []
        for t in np.sort(np.concatenate([f["t"].to_numpy(float) for f in frames])):
            if start is None or t - start >= seconds:
                start, n = float(t), 0
            n += 1
            out.append((str(key[0]), float(t), n, n <= most))
        state.update((start, n))
        if forget:
            state.setTimeoutDuration(int(seconds * 2000))
        yield pd.DataFrame(out, columns=["k", "t", "n_in_window", "allowed"])

    return run


def limit_stream(stream: DataFrame, seconds: float = SECONDS, most: int = MOST, forget: bool = True) -> DataFrame:
    """Admission of a stream of (k, t in seconds): window start and count per key are its state.

    With ``forget`` the state of a key that stays away for two windows is dropped; a query with such timers
    never ends by itself, so one that is to stop when all is read sets it to False.
    """
    timer = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return stream.where("k IS NOT NULL AND t IS NOT NULL").groupBy("k").applyInPandasWithState(_admit(seconds, most, forget), LIMITED, "start double, n long", "append", timer)


def grant_times(requests: DataFrame, host: str, at: str, rate: float, interval: float = 0.0, order: str | None = None) -> DataFrame:
    """Add ``granted``: when a token bucket (``rate`` a second, burst of as many) lets each request go.

    With ``interval`` requests of a host are also that far apart at least. Times are in seconds. The bucket
    is full again at a time with the closed form (i + 1)/rate + max over j <= i of (t_j - j/rate), so both
    limits are running maxima. Rows are range-partitioned by host and time, so a host that holds much of
    them lies in pieces; each piece takes up what the earlier ones of its host come to.
    """
    rate = max(1.0, rate)
    spark, keys = requests.sparkSession, [at] + ([order] if order else [])
    laid = requests.repartitionByRange(parallelism(spark), host, *keys).sortWithinPartitions(host, *keys).withColumn("__part", F.spark_partition_id())
    laid = materialize(laid, "requests")
    rows = Window.partitionBy("__part", host).orderBy(*keys)
    running = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(host).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, what: Column, name: str) -> DataFrame:
        """Add what the earlier pieces of each host come to; a host has a piece in few partitions."""
        pieces = df.groupBy(host, "__part").agg(what.alias("__w")).withColumn(name, (F.sum if name == "__before" else F.max)("__w").over(earlier)).drop("__w")
        pieces = pieces.withColumnsRenamed({host: "__host", "__part": "__piece"})
        return df.join(broadcast_if_small(materialize(pieces, "pieces")), F.col(host).eqNullSafe(F.col("__host")) & (F.col("__part") == F.col("__piece"))).drop("__host", "__piece")

    df = carried(laid, F.count("*"), "__before")
    df = df.withColumn("__i", F.coalesce("__before", F.lit(0)) + F.row_number().over(rows) - 1.0)
    df = carried(df, F.max(F.col(at) - F.col("__i") / rate), "__late")
    full = F.greatest(F.max(F.col(at) - F.col("__i") / rate).over(running), F.col("__late")) + (F.col("__i") + 1) / rate
    df = df.withColumn("__full", full)
    last = F.coalesce(F.lag("__full").over(rows), F.col("__late") + F.col("__i") / rate)
    df = df.withColumn("__bucket", F.greatest(F.col(at), F.coalesce(last, F.col(at)) - (rate - 1) / rate))
    df = carried(df, F.max(F.col("__bucket") - F.col("__i") * interval), "__later")
    spaced = F.greatest(F.max(F.col("__bucket") - F.col("__i") * interval).over(running), F.col("__later")) + F.col("__i") * interval
    return df.withColumn("granted", spaced).select(*requests.columns, "granted")
