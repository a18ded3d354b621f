"""Recorded responses as the web: redirects, retries, headers and charsets without a network.

Responses: method, url, status, location, headers, body (binary), error, attempt. The same logic as
the live source, so that every audit also runs on a recording.
"""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import urls
from auditlake.session import broadcast_if_small, materialize

MAX_HOPS = 10
MAX_RETRIES = 3
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([^\s\"'>;/]+)", re.I)


def headers_of(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Names in lower case; values that are not ASCII are dropped; the last of repeated names counts."""
    return {k.lower(): v for k, v in pairs if v is not None and v.isascii()}


def charset_of(content_type: str | None, body: bytes) -> str:
    """Charset of a body: the header's, else the first in its first 1024 bytes, else UTF-8."""
    for text in (content_type or "", body[:1024].decode("latin-1")):
        m = _CHARSET.search(text)
        if m:
            try:
                name = codecs.lookup(m.group(1)).name
            except LookupError:
                return "utf-8"
            return "cp1252" if name in ("iso8859-1", "ascii") else name
    return "utf-8"


def decode_body(body: bytes | None, content_type: str | None) -> str:
    """Text of a body; what can't be decoded is replaced, so this never fails."""
    body = body or b""
    try:
        return body.decode(charset_of(content_type, body), "replace")
    except (UnicodeError, LookupError, ValueError):
        return body.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decode_html(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_body(b, c if isinstance(c, str) else None) for b, c in zip(body, content_type, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    """``ref`` against ``base``; null if either can't be read."""
    out = []
    for b, r in zip(base, ref, strict=True):
        found = urls.parse(r, urls.parsed(b)) if isinstance(b, str) and isinstance(r, str) else None
        out.append(found.text() if found else None)
    return pd.Series(out, dtype=object)


def retry_wait(retry_after: Column, attempt: Column) -> Column:
    """Seconds to wait before the next try: whole Retry-After seconds, else 1, 2, 4, ..."""
    return F.coalesce(retry_after.try_cast("bigint"), F.pow(F.lit(2), attempt).cast("bigint"))


def final_attempts(responses: DataFrame) -> DataFrame:
    """One response per (method, url): the first that is no 429 or 503, else that of the last retry."""
    n = F.coalesce(F.col("attempt"), F.lit(0))
    tried = responses.where(n <= MAX_RETRIES).withColumn("again", F.col("status").isin(429, 503) & F.col("error").isNull())
    order = F.struct(F.when(F.col("again"), F.lit(1)).otherwise(F.lit(0)).alias("again"), F.when(F.col("again"), -n).otherwise(n).alias("n"))
    cols = [c for c in responses.columns if c not in ("method", "url")]
    best = tried.groupBy("method", "url").agg(F.min_by(F.struct(*cols), order).alias("r"))
    return best.select("method", "url", "r.*")


def fetch(seeds: DataFrame, source, max_hops: int = MAX_HOPS) -> DataFrame:
    """Follow redirects in ``source`` (recorded responses or a ``Web``) from each ``requested`` URL of ``seeds`` (with any other columns).

    A redirect needs a 3xx status and a Location. ``redirect_chain`` holds the URLs visited before the final
    one. A URL met twice, or more than ``max_hops`` hops, gives error "RedirectLoop"; a URL without a
    record, or one whose record failed, gives its error. One join per hop over statuses and locations alone;
    only rows that still move take part in the next, and hops end when none do. Headers and bodies are
    fetched once, for the final URLs. A column delay (seconds) is the least time between a host's requests.
    """
    from auditlake.sources.web import as_web

    web = as_web(source)
    keep = seeds.columns
    moving = seeds.withColumn("url", F.col("requested")).withColumn("redirect_chain", F.array().cast("array<string>"))
    done, sources = None, []
    for hop in range(max_hops + 1):
        raw = web(moving.select("url", *[c for c in keep if c == "delay"]), "GET")
        if not any(raw is x for x in sources):
            sources.append(raw)
        table = final_attempts(raw.select("method", "url", "status", "location", "error", "attempt")).select(F.col("url").alias("r_url"), F.col("status").alias("r_status"), "location", F.col("error").alias("r_error"), F.coalesce("attempt", F.lit(0)).alias("r_attempt"))
        met = moving.join(table, moving["url"] == table["r_url"], "left")
        redirect = F.col("r_status").between(300, 399) & F.col("location").isNotNull() & F.col("r_error").isNull()
        met = met.withColumn("next", F.when(redirect, join_url(F.col("url"), F.coalesce("location", F.lit("")))))
        loops = F.col("next").isNotNull() & (F.array_contains("redirect_chain", F.col("next")) | (F.col("next") == F.col("url")) | F.lit(hop >= max_hops))
        error = F.when(F.col("r_url").isNull(), "NotRecorded").when(F.col("r_error").isNotNull(), F.col("r_error")).when(loops, "RedirectLoop")
        ended = F.col("next").isNull() | loops
        chain = F.when(loops, F.concat("redirect_chain", F.array("url"))).otherwise(F.col("redirect_chain"))
        part = met.where(ended).select(*keep, "url", F.col("r_status").alias("status"), chain.alias("redirect_chain"), error.alias("error"), "r_attempt")
        done = part if done is None else done.unionByName(part)
        if hop == max_hops:
            break
        moving = materialize(met.where(~ended).select(*keep, F.col("next").alias("url"), F.concat("redirect_chain", F.array("url")).alias("redirect_chain")), "hop")
        if moving.isEmpty():
            break
    done = materialize(done, "fetched")
    wanted = broadcast_if_small(done.select(F.col("url").alias("b_url"), F.col("r_attempt").alias("b_attempt")).where("b_attempt IS NOT NULL").distinct())
    bodies = None
    for raw in sources:
        got = raw.where("method = 'GET'").withColumn("attempt", F.coalesce("attempt", F.lit(0))).join(wanted, (F.col("url") == F.col("b_url")) & (F.col("attempt") == F.col("b_attempt"))).select("b_url", "b_attempt", "headers", "body")
        bodies = got if bodies is None else bodies.unionByName(got)
    bodies = bodies.groupBy("b_url", "b_attempt").agg(F.first(F.struct("headers", "body")).alias("r"))
    joined = done.join(bodies, (done["url"] == bodies["b_url"]) & (done["r_attempt"] == bodies["b_attempt"]), "left")
    full = joined.select(*keep, "url", "status", "redirect_chain", F.coalesce(F.col("r.headers"), F.create_map().cast("map<string,string>")).alias("headers"), F.col("r.body").alias("body"), "error")
    return full.withColumn("html", decode_html("body", F.try_element_at("headers", F.lit("content-type")))).drop("body")
