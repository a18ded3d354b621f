"""robots.txt: parsing, evaluation, crawl delays and the rules on it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.operators.rules import CRITICAL, INFO, WARNING, finding, first_of, none
from auditlake.session import broadcast_if_small

_RULE = T.ArrayType(T.StructType([T.StructField("ua", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("prefix", T.StringType())]))
_DELAY = T.ArrayType(T.StructType([T.StructField("ua", T.StringType()), T.StructField("secs", T.DoubleType())]))
PARSED = T.StructType([T.StructField("rules", _RULE), T.StructField("delays", _DELAY), T.StructField("disallow_all", T.BooleanType()), T.StructField("has_sitemap", T.BooleanType())])


def parse(body: str | None) -> dict:
    """Rules, delays and flags of one file.

    Text after # is dropped; a line that is empty then (also a mere comment) ends the block. A new
    user-agent line does not: the agents named since the block began share its rules. Empty values
    are ignored. ``disallow_all``: ``Disallow: /`` while ``*`` is among the agents.
    """
    agents: list[str] = []
    prefixes: list[tuple[str, str]] = []
    delay: float | None = None
    out: dict = {"rules": [], "delays": [], "disallow_all": False, "has_sitemap": False}

    def close() -> None:
        nonlocal delay
        out["rules"] += [{"ua": a, "kind": k, "prefix": p} for a in agents for k, p in prefixes]
        if delay is not None:
            out["delays"] += [{"ua": a, "secs": delay} for a in agents]
        agents.clear()
        prefixes.clear()
        delay = None

    for raw in (body or "").split("\n"):
        line = raw.split("#", 1)[0].strip()
        if not line:
            close()
            continue
        name, colon, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents.append(value.lower())
        elif name in ("disallow", "allow") and value:
            prefixes.append((name, value))
            out["disallow_all"] |= name == "disallow" and value == "/" and "*" in agents
        elif name == "crawl-delay":
            try:
                delay = float(value)
            except ValueError:
                pass
        elif name == "sitemap" and value:
            out["has_sitemap"] = True
    close()
    return out


@F.pandas_udf(PARSED)
def parse_robots(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(b if isinstance(b, str) else None) for b in body], columns=PARSED.names)


def rule_rows(robots: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """(key, ua, kind, prefix) of all files with window functions alone: no Python.

    Blocks are numbered by a running count of blank lines within each file.
    """
    lines = robots.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\r?\n")).alias("pos", "raw"))
    clean = lines.withColumn("line", F.trim(F.regexp_replace(F.substring_index("raw", "#", 1), r"\s+", " ")))
    block = clean.withColumn("block", F.sum((F.col("line") == "").cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    pair = block.where(F.instr("line", ":") > 0).select(key, "block", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    agents = pair.where("name = 'user-agent'").select(key, "block", F.lower("value").alias("ua"))
    rules = pair.where("name IN ('allow', 'disallow') AND value <> ''").select(key, "block", F.col("name").alias("kind"), F.col("value").alias("prefix"))
    return agents.join(rules, [key, "block"]).select(key, "ua", "kind", "prefix")


def decisions(paths: DataFrame, rules: DataFrame, user_agent: str, key: str = "host", path: str = "path") -> DataFrame:
    """``paths`` with ``allowed``: the longest matching prefix decides, a tie allows, no match allows.

    Rules for agents whose name occurs in ``user_agent`` count; only where a host has none, those
    for ``*``. Prefixes match by bytes, without wildcards. Rows with a null key or path are allowed.
    """
    ua = user_agent.lower()
    named = rules.withColumn("own", (F.col("ua") != "*") & F.lit(ua).contains(F.col("ua"))).where("own OR ua = '*'")
    scope = named.groupBy(key).agg(F.max("own").alias("has_own"))
    used = named.join(scope, key).where(F.col("own") == F.col("has_own")).select(key, "kind", "prefix").distinct()
    distinct = paths.select(key, path).distinct()
    hit = distinct.join(broadcast_if_small(used), key, "left").where(F.col("prefix").isNull() | F.startswith(F.col(path), F.col("prefix")))
    best = hit.groupBy(key, path).agg(F.max(F.when(F.col("kind") == "allow", F.octet_length("prefix"))).alias("a"), F.max(F.when(F.col("kind") == "disallow", F.octet_length("prefix"))).alias("d"))
    verdict = best.select(key, path, (F.col("d").isNull() | (F.coalesce("a", F.lit(-1)) >= F.col("d"))).alias("verdict"))
    return paths.join(verdict, [key, path], "left").withColumn("allowed", F.coalesce("verdict", F.lit(True))).drop("verdict")


def crawl_delays(parsed: DataFrame, key: str = "host", column: str = "robots") -> DataFrame:
    """(key, delay): the largest delay any block names."""
    rows = parsed.select(key, F.explode(f"{column}.delays").alias("d"))
    return rows.where(~F.isnan("d.secs")).groupBy(key).agg(F.max("d.secs").alias("delay"))


def robots_findings(status: Column, robots: Column) -> Column:
    """Findings on one host's file; a null or non-2xx status means that there is none."""
    absent = F.coalesce(~status.between(200, 299), F.lit(True))
    missing = F.array(finding("robots.missing", "Crawlability", WARNING, "robots.txt not found or inaccessible", 15))
    every = first_of((robots["disallow_all"], finding("robots.disallow-all", "Crawlability", CRITICAL, "robots.txt disallows all crawlers (Disallow: / for User-agent: *)", 40)))
    no_map = first_of((~robots["has_sitemap"], finding("robots.no-sitemap", "Crawlability", INFO, "robots.txt does not contain a Sitemap: directive", 5)))
    return F.when(absent, missing).otherwise(F.coalesce(F.concat(every, no_map), none()))
