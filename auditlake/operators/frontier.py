"""Breadth-first crawl over link tables: levels of joins with a seen set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import materialize


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(job_id, url, depth, place): URLs reached from each job's seeds within ``max_depth`` links.

    ``seeds``: job_id, url. ``edges``: src, dst, pos (place of the link on its page). A URL counts once per
    job, at its least depth. With ``max_pages`` each job keeps the first so many in the order (depth,
    place of the parent, place of the link); a root always counts, even for 0; without it the place is null
    from depth 1 on. The seen set is an
    anti join; each level is written out, so a lost executor costs no more than one level. Nulls reach
    nothing.
    """
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min(F.coalesce("pos", F.lit(0))).alias("pos"))
    first = seeds.where("url IS NOT NULL").select("job_id", "url").distinct()
    order = Window.partitionBy("job_id").orderBy("url")
    level = materialize(first.withColumn("depth", F.lit(0)).withColumn("place", F.row_number().over(order).cast("bigint")), "level")
    seen = level
    for depth in range(1, max_depth + 1):
        reached = level.join(links, level["url"] == links["src"]).select("job_id", F.col("dst").alias("url"), F.col("place").alias("parent"), "pos")
        fresh = reached.groupBy("job_id", "url").agg(F.min(F.struct("parent", "pos")).alias("first")).join(seen.select("job_id", "url"), ["job_id", "url"], "left_anti")
        if max_pages is None:  # the order decides nothing then
            new = fresh.select("job_id", "url", F.lit(depth).alias("depth"), F.lit(None).cast("bigint").alias("place"))
        else:  # each task keeps a job's first rows before the shuffle, as no more can count
            counts = seen.groupBy("job_id").agg(F.max("place").alias("used"))
            ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy("first.parent", "first.pos", "url"))).where(F.col("rank") <= max(1, max_pages)).join(counts, "job_id")
            new = ranked.select("job_id", "url", F.lit(depth).alias("depth"), (F.col("used") + F.col("rank")).alias("place")).where(F.col("place") <= max_pages)
        level = materialize(new, "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def resolve_redirects(starts: DataFrame, hops: DataFrame, max_hops: int = 10) -> DataFrame:
    """(url, final, chain, is_loop): where redirects ``hops`` (src, dst) lead from each ``url``.

    ``chain`` holds the URLs before the final one. A URL met again or more than ``max_hops`` hops is a loop.
    """
    table = hops.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.min("dst").alias("dst"))
    moving = starts.select("url").where("url IS NOT NULL").distinct().select("url", F.col("url").alias("at"), F.array().cast("array<string>").alias("chain"))
    out = None
    for hop in range(max_hops + 1):
        met = moving.join(table, moving["at"] == table["src"], "left")
        again = F.col("dst").isNotNull() & (F.array_contains("chain", F.col("dst")) | (F.col("dst") == F.col("at")) | F.lit(hop >= max_hops))
        grown = F.concat("chain", F.array("at"))
        part = met.where(F.col("dst").isNull() | again).select("url", F.col("at").alias("final"), F.when(again, grown).otherwise(F.col("chain")).alias("chain"), again.alias("is_loop"))
        out = part if out is None else out.unionByName(part)
        moving = materialize(met.where(F.col("dst").isNotNull() & ~again).select("url", F.col("dst").alias("at"), grown.alias("chain")), "hop")
        if moving.isEmpty():
            break
    return out
