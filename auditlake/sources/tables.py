"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import broadcast_if_small, tune

#: Columns that say where a row lies; present only on frames read by ``table(..., locate=True)``.
FILE, ROW = "__file", "__row"


def table(spark: SparkSession, sf_dir: str, name: str, locate: bool = False) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; ``locate`` adds the row's file and position."""
    df = tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    if locate:
        df = df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    return df


def first_copies(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key`` where repeated rows are equal; rows with a null key are dropped.

    With file positions only the keys are shuffled: the few surplus copies are found by a narrow
    aggregation and taken out by an anti join, so wide columns stay in the scan's stage.
    """
    if FILE not in df.columns:
        return df.where(F.col(key).isNotNull()).dropDuplicates([key])
    keys = df.select(key, FILE, ROW).where(F.col(key).isNotNull())
    more = keys.groupBy(key).agg(F.count("*").alias("__n"), F.min(F.struct(FILE, ROW)).alias("__keep")).where("__n > 1")
    surplus = broadcast_if_small(more.select(key, "__keep"))
    joined = df.where(F.col(key).isNotNull()).join(surplus, key, "left")
    kept = joined.where(F.col("__keep").isNull() | ((F.col("__keep")[FILE] == F.col(FILE)) & (F.col("__keep")[ROW] == F.col(ROW))))
    return kept.drop("__keep", FILE, ROW)


def spread(df: DataFrame) -> DataFrame:
    """Move rows to idle cores before costly work per row: only where a scan has fewer tasks than cores.

    Large inputs have more splits than that and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
