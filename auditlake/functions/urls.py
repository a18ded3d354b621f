"""URLs as browsers read them (the part of the WHATWG rules that web crawls meet), and normalisation."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import quote_plus, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
# Query keys that only track visitors.
TRACKING_KEYS = ("fbclid", "gclid", "mc_eid", "ref", "igshid")
TRACKING_PREFIX = "utm_"

_SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.\-]*):")
_FORBIDDEN_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_CONTROLS = "".join(map(chr, range(0x21)))


class Url(NamedTuple):
    scheme: str
    host: str | None
    port: str | None
    path: str
    query: str | None
    fragment: str | None
    user: str = ""

    def text(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//" + (self.user + "@" if self.user else "") + self.host + (f":{self.port}" if self.port else "")
        out += self.path
        if self.query is not None:
            out += "?" + self.query
        return out + ("#" + self.fragment if self.fragment is not None else "")


def _escape(text: str, extra: str) -> str:
    """Percent-encode controls, non-ASCII and the characters in ``extra``."""
    if text.isascii() and text.isprintable() and not any(c in text for c in extra):
        return text
    return "".join(c if " " <= c < "\x7f" and c not in extra else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        return raw.lower() if raw.endswith("]") and len(raw) > 3 else None
    name = unquote_to_bytes(raw).decode("utf-8", "replace")
    if not name.isascii():
        try:
            name = name.encode("idna").decode("ascii")
        except UnicodeError:
            return None
    name = name.lower()
    return None if not name or _FORBIDDEN_HOST.search(name) else name


def _segments(path: str, base: list[str]) -> str:
    """Absolute path with dot segments resolved, on top of the segments of ``base``."""
    out = list(base)
    parts = path.split("/")
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """Parse an absolute URL, or a reference against ``base``; None where browsers give up."""
    if text is None:
        return None
    text = text.strip(_CONTROLS).replace("\t", "").replace("\n", "").replace("\r", "")
    m = _SCHEME.match(text)
    rest, fragment = (text.split("#", 1) + [None])[:2]
    fragment = None if fragment is None else _escape(fragment, ' "<>`')
    if m:
        scheme = m.group(1).lower()
        rest = rest[m.end() :]
        if scheme not in DEFAULT_PORTS:
            body, query = (rest.split("?", 1) + [None])[:2]
            if body.startswith("//"):
                host, _, path = body[2:].partition("/")
                return Url(scheme, host, None, "/" + path if path or body.endswith("/") else "", query, fragment)
            return Url(scheme, None, None, _escape(body, ""), query, fragment)
        if not (base and base.scheme == scheme and not rest.replace("\\", "/").startswith("/")):
            return _authority(scheme, rest, fragment)
    elif base is None:
        return None
    scheme = base.scheme
    if scheme not in DEFAULT_PORTS:
        return None
    if rest.replace("\\", "/").startswith("//"):
        return _authority(scheme, rest, fragment)
    path, query = (rest.split("?", 1) + [None])[:2]
    path = path.replace("\\", "/")
    query = None if query is None else _escape(query, " \"#<>'")
    if not path:
        return base._replace(query=base.query if query is None else query, fragment=fragment)
    kept = [] if path.startswith("/") else base.path.split("/")[1:-1]
    return base._replace(path=_escape(_segments(path.lstrip("/") if not kept and path.startswith("/") and not path.startswith("//") else path[path.startswith("/") :], kept), ' "#<>?`{}'), query=query, fragment=fragment)


def _authority(scheme: str, rest: str, fragment: str | None) -> Url | None:
    body, query = (rest.split("?", 1) + [None])[:2]
    body = body.replace("\\", "/").lstrip("/")
    authority, slash, path = body.partition("/")
    user, at, hostport = authority.rpartition("@")
    if hostport.startswith("["):
        host, _, port = hostport.partition("]")
        host, port = host + "]", port.removeprefix(":")
    else:
        host, _, port = hostport.partition(":")
    name = _host(host)
    if name is None or (port and (not port.isdigit() or not port.isascii() or int(port) > 65535)):
        return None
    port = str(int(port)) if port else ""
    path = _escape(_segments(path, []), ' "#<>?`{}')
    return Url(scheme, name, None if not port or port == DEFAULT_PORTS[scheme] else port, path, None if query is None else _escape(query, " \"#<>'"), fragment, _escape(user, ' "#<>?`{}/;=@[\\]^|') if at else "")


@lru_cache(maxsize=50_000)
def parsed(text: str | None) -> Url | None:
    return parse(text)


def normalise(base: str | None, href: str | None) -> str | None:
    """``href`` against ``base`` as a crawl key: http(s) only, no fragment, no tracking keys, pairs sorted.

    Pairs keep their order among equal keys and are written in form encoding; without pairs there is no
    question mark. Null or unusable input gives null. Idempotent.
    """
    root = parsed(base)
    url = parse(href, root) if root else None
    if url is None or url.scheme not in ("http", "https"):
        return None
    query = None
    if url.query:
        pairs = []
        for part in url.query.split("&"):
            if part:
                k, _, v = part.partition("=")
                key = unquote_to_bytes(k.replace("+", " ")).decode("utf-8", "replace")
                if key not in TRACKING_KEYS and not key.startswith(TRACKING_PREFIX):
                    pairs.append((key, unquote_to_bytes(v.replace("+", " ")).decode("utf-8", "replace")))
        pairs.sort(key=lambda p: p[0].encode())
        query = "&".join(f"{_form(k)}={_form(v)}" for k, v in pairs) or None
    return url._replace(query=query, fragment=None).text()


def _form(text: str) -> str:
    return quote_plus(text, safe="*").replace("~", "%7E")


def host_of(text: str | None) -> str | None:
    url = parsed(text)
    return url.host if url else None


def same_site(a: str | None, b: str | None) -> bool:
    """Exactly equal hosts; a missing host equals nothing; port and scheme do not matter."""
    x, y = host_of(a), host_of(b)
    return x is not None and x == y


def discover(base: str, hrefs: list[str]) -> list[str]:
    """Normalised same-host links in order of first appearance; links to the page itself stay."""
    found = (normalise(base, h) for h in hrefs)
    return list(dict.fromkeys(u for u in found if u and same_site(base, u)))


def partition_links(base: str, hrefs: list[str]) -> tuple[list[str], list[str]]:
    """(internal, external) normalised links without repeats; bare fragments are left out."""
    found = dict.fromkeys(u for h in hrefs if not h.strip().startswith("#") and (u := normalise(base, h)))
    return [u for u in found if same_site(base, u)], [u for u in found if not same_site(base, u)]


PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("scheme", "host", "port", "path", "query", "fragment")])


@F.pandas_udf(PARTS)
def url_parts(urls: pd.Series) -> pd.DataFrame:
    """Parts of an absolute URL; all null if it can't be read."""
    rows = [parsed(u) if isinstance(u, str) else None for u in urls]
    return pd.DataFrame([tuple(r)[:6] if r else (None,) * 6 for r in rows], columns=PARTS.names)


@F.pandas_udf(T.StringType())
def normalise_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """``normalise`` over columns."""
    return pd.Series([normalise(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def simple_normalise(url: Column) -> Column:
    """The same without Python for absolute http(s) URLs that need no escaping: all built-in functions."""
    bare = F.substring_index(url, "#", 1)
    query = F.when(F.instr(bare, "?") > 0, F.substring(bare, F.instr(bare, "?") + 1, F.length(bare)))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.filter(pairs, lambda s: ~s["k"].isin(*TRACKING_KEYS) & ~s["k"].startswith(TRACKING_PREFIX))
    text = F.array_join(F.transform(F.array_sort(kept), lambda s: s["p"]), "&")
    head = F.substring_index(bare, "?", 1)
    host = F.regexp_extract(head, r"^([a-zA-Z]+://[^/]*)", 1)
    path = F.substring(head, F.length(host) + 1, F.length(head))
    full = F.concat(F.lower(host), F.when(path == "", "/").otherwise(path))
    return F.when(F.lower(host).rlike("^https?://."), F.when(F.coalesce(text, F.lit("")) == "", full).otherwise(F.concat(full, F.lit("?"), text)))


def with_links(pages: DataFrame, url: str = "url", links: str = "links") -> DataFrame:
    """Add internal, external and discovered links of each page, computed in one Arrow pass."""
    schema = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("internal", "external", "discovered")])

    @F.pandas_udf(schema)
    def run(base: pd.Series, hrefs: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for b, h in zip(base, hrefs, strict=True):
            found = [x for x in h if x is not None] if h is not None else []
            out.append((*partition_links(b, found), discover(b, found)) if isinstance(b, str) else ([], [], []))
        return pd.DataFrame(out, columns=schema.names)

    return pages.withColumn("__l", run(url, links)).select("*", "__l.*").drop("__l")

