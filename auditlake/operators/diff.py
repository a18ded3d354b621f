"""Comparison of two reports: pages, categories, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_entries(pages: DataFrame, keys: list[str], pos: str, values: list[str]) -> DataFrame:
    """One row per key: of repeated URLs on a side the later counts."""
    return pages.groupBy(*keys).agg(F.max(F.struct(pos, *values)).alias("r")).select(*keys, *[F.col(f"r.{v}").alias(v) for v in values])


def page_diff(before: DataFrame, after: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(keys, kind, before_score, after_score, delta): Added, Removed, Changed or Unchanged by exact key.

    Each side has one row per key (see ``last_entries``). The delta of a page on one side only is 0.
    """
    b = before.select(*keys, F.col(score).alias("before_score"), F.lit(True).alias("b"))
    a = after.select(*keys, F.col(score).alias("after_score"), F.lit(True).alias("a"))
    both = b.join(a, keys, "full_outer")
    kind = F.when(F.col("b").isNull(), "Added").when(F.col("a").isNull(), "Removed").when(F.col("before_score").eqNullSafe(F.col("after_score")), "Unchanged").otherwise("Changed")
    delta = F.when(F.col("a") & F.col("b"), F.coalesce(F.col("after_score") - F.col("before_score"), F.lit(0))).otherwise(0).cast("int")
    return both.select(*keys, kind.alias("kind"), "before_score", "after_score", delta.alias("delta"))


def category_deltas(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, delta): difference of the truncated means; a side without rows counts as 0.

    ``before`` and ``after``: keys, category, score. A category on neither side has no row.
    """
    by = [*keys, "category"]
    mean = F.floor(F.sum("score") / F.count("score"))
    b = before.where("score IS NOT NULL").groupBy(*by).agg(mean.alias("b"))
    a = after.where("score IS NOT NULL").groupBy(*by).agg(mean.alias("a"))
    return b.join(a, by, "full_outer").select(*by, (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).cast("int").alias("delta"))


def summary(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of regressions, improvements, unchanged, added and removed pages."""
    kind, d = F.col("kind"), F.col("delta")
    return diff.groupBy(*keys).agg(
        F.count_if((kind == "Changed") & (d < 0)).alias("regressions"),
        F.count_if((kind == "Changed") & (d >= 0)).alias("improvements"),
        F.count_if(kind == "Unchanged").alias("unchanged"),
        F.count_if(kind == "Added").alias("added"),
        F.count_if(kind == "Removed").alias("removed"),
    )


def ordered(diff: DataFrame) -> DataFrame:
    """Delta ascending, then URL."""
    return diff.orderBy("delta", "url")


def signed(delta: Column) -> Column:
    """+n for a gain, 0 as 0."""
    return F.when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).otherwise(delta.cast("string"))


def short(url: Column, n: int = 60) -> Column:
    """At most ``n`` characters, an ellipsis where more were cut."""
    return F.when(F.char_length(url) > n, F.concat(F.left(url, F.lit(n)), F.lit("…"))).otherwise(url)
