"""From findings to category, page and site scores; integer arithmetic throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.rules import CATEGORIES


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def category_score(findings: Column, category: str) -> Column:
    """100 less the penalties of the category, summed first, then clamped."""
    own = F.filter(findings, lambda f: f["category"] == category)
    return clamp(F.lit(100) - F.aggregate(own, F.lit(0), lambda a, f: a + F.coalesce(f["penalty"], F.lit(0)))).cast("int")


def weighted(scores: dict[str, Column]) -> Column:
    """Σ score·weight / 100 rounded half up: exact, as both are whole numbers."""
    total = sum((F.coalesce(scores[k], F.lit(100)) * w for k, w in CATEGORIES), F.lit(0))
    return clamp(F.floor((total + 50) / 100)).cast("int")


def with_scores(pages: DataFrame) -> DataFrame:
    """Add ``category_scores`` (all seven) and ``score`` to pages with a findings array; no shuffle."""
    per = {k: category_score(F.col("findings"), k) for k, _ in CATEGORIES}
    scores = F.create_map(*[x for k, c in per.items() for x in (F.lit(k), c)])
    df = pages.withColumn("category_scores", scores)
    return df.withColumn("score", weighted({k: F.try_element_at("category_scores", F.lit(k)) for k, _ in CATEGORIES}))


def categories(spark: SparkSession) -> DataFrame:
    """The seven categories with ordinal and weight."""
    return spark.createDataFrame([(k, i, w) for i, (k, w) in enumerate(CATEGORIES)], "category string, ordinal int, weight int")


def scores_from_rows(pages: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """(key, category, category_score) of all seven categories for each page, from finding rows.

    Penalties are summed per page and category before the join; other categories are ignored. Repeated
    pages give one row, a null key none.
    """
    names = [k for k, _ in CATEGORIES]
    sums = findings.where(F.col("category").isin(names)).groupBy(key, "category").agg(F.sum("penalty").alias("p"))
    per_page = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("category", "p"))).alias("m"))
    known = pages.select(key).where(F.col(key).isNotNull()).distinct().join(per_page, key, "left")
    score = lambda k: clamp(F.lit(100) - F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))).cast("int")
    rows = F.array(*[F.struct(F.lit(k).alias("category"), score(k).alias("category_score")) for k in names])
    return known.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def page_score_from_rows(category_scores: DataFrame, key: str) -> DataFrame:
    """(key, score) from rows of category scores."""
    weight = F.create_map(*[x for k, w in CATEGORIES for x in (F.lit(k), F.lit(w))])
    total = F.sum(F.col("category_score") * F.try_element_at(weight, F.col("category")))
    return category_scores.groupBy(key).agg(clamp(F.floor((total + 50) / 100)).cast("int").alias("score"))


def truncated_mean(score: Column) -> Column:
    """Whole mean as integer division gives it; 0 without rows."""
    return F.coalesce(F.floor(F.sum(score) / F.count(score)), F.lit(0)).cast("int")


def site_scores(pages: DataFrame, key: str, score: str = "score") -> DataFrame:
    """(key, n_pages, site_score): truncated mean of the page scores."""
    return pages.groupBy(key).agg(F.count(score).alias("n_pages"), truncated_mean(F.col(score)).alias("site_score"))


def category_means(scores: DataFrame, key: str) -> DataFrame:
    """(key, category, mean, bar): truncated mean and the length of its bar of ten."""
    means = scores.groupBy(key, "category").agg(truncated_mean(F.col("score")).alias("mean"))
    return means.withColumn("bar", F.floor((F.col("mean") + 5) / 10).cast("int"))


def severity_counts(findings: DataFrame, key: str) -> DataFrame:
    """(key, critical, warning, info) counts."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy(key).agg(n("Critical").alias("critical"), n("Warning").alias("warning"), n("Info").alias("info"))


def band(score: Column) -> Column:
    """good from 90, fair from 70, else poor."""
    return F.when(score >= 90, "good").when(score >= 70, "fair").otherwise("poor")
