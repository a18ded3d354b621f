"""Page facts from HTML: one pass over the tags of each page, one Arrow boundary for all facts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.functions import urls

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style noscript title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style noscript".split())
CONTENT_TAGS = frozenset("p article section main li h1 h2 h3 h4 h5 h6".split())
SOURCES = frozenset("img script iframe audio video source track embed".split())
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: White space as Unicode defines it.
SPACE = " \t\n\x0b\x0c\r\x85\xa0                　"

FACTS = (
    "struct<title:string,description:string,canonical:string,canonicals:array<string>,"
    "headings:array<struct<level:int,text:string>>,images:array<struct<src:string,alt:string>>,"
    "properties:map<string,string>,names:map<string,string>,links:array<string>,resources:array<string>,"
    "text_bytes:bigint,html_bytes:bigint,content_tags:int,"
    "scheme:string,host:string,canonical_readable:boolean,canonical_host:string,resolved:string,resolved_host:string,resolved_same:boolean>"
)
_TYPE = pa.struct(
    [
        ("title", pa.string()),
        ("description", pa.string()),
        ("canonical", pa.string()),
        ("canonicals", pa.list_(pa.string())),
        ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))),
        ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())]))),
        ("properties", pa.map_(pa.string(), pa.string())),
        ("names", pa.map_(pa.string(), pa.string())),
        ("links", pa.list_(pa.string())),
        ("resources", pa.list_(pa.string())),
        ("text_bytes", pa.int64()),
        ("html_bytes", pa.int64()),
        ("content_tags", pa.int32()),
        ("scheme", pa.string()),
        ("host", pa.string()),
        ("canonical_readable", pa.bool_()),
        ("canonical_host", pa.string()),
        ("resolved", pa.string()),
        ("resolved_host", pa.string()),
        ("resolved_same", pa.bool_()),
    ]
)


def attributes(text: str) -> dict[str, str]:
    """Names in lower case, entities decoded, the first of repeated names."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def facts(page: str | None, url: str | None = None) -> dict:
    """Facts of one page. Null html gives the facts of an empty page.

    Of titles, descriptions and named meta tags the first counts, even where it lacks a content. Headings
    are ordered by level, then place. Text in scripts, styles and noscript is not visible; its length
    counts UTF-8 bytes of each trimmed text node.
    """
    page = page or ""
    title = None
    metas: list[dict] = []
    canon: list[str | None] = []
    headings: list[list] = []
    images, links = [], []
    by_kind: dict[str, list[str]] = {"src": [], "data": [], "href": []}
    text_bytes = tags = 0
    open_heading: list | None = None
    at, n = 0, len(page)

    def text(raw: str) -> None:
        nonlocal text_bytes
        if raw:
            decoded = html.unescape(raw) if "&" in raw else raw
            trimmed = decoded.strip(SPACE)
            if trimmed:
                text_bytes += len(trimmed.encode("utf-8", "replace"))
            if open_heading is not None:
                open_heading[1] += decoded

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if open_heading is not None and len(name) == 2 and name[0] == "h" and name[1] in "123456":
                open_heading = None
            continue
        raw_attrs = m.group(3)
        if name in CONTENT_TAGS:
            tags += 1
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            open_heading = [int(name[1]), ""]
            headings.append(open_heading)
        elif name == "meta":
            metas.append(attributes(raw_attrs))
        elif name == "link":
            a = attributes(raw_attrs)
            if a.get("rel") == "canonical":
                canon.append(a["href"].strip(SPACE) if "href" in a else None)
            if "href" in a:
                by_kind["href"].append(a["href"])
        elif name == "a":
            a = attributes(raw_attrs)
            if "href" in a:
                links.append(a["href"])
        elif name in SOURCES or name == "object":
            a = attributes(raw_attrs)
            if name == "img":
                images.append({"src": a.get("src", ""), "alt": a.get("alt")})
            if name == "object":
                if "data" in a:
                    by_kind["data"].append(a["data"])
            elif "src" in a:
                by_kind["src"].append(a["src"])
        if name in RAW:
            end = _ENDS[name].search(page, at)
            stop = end.start() if end else n
            inner = page[at:stop]
            if name == "title" and title is None:
                title = html.unescape(inner).strip(SPACE)
            if name not in HIDDEN:
                text(inner)
            at = stop
    first_name: dict[str, str | None] = {}
    first_property: dict[str, str | None] = {}
    for a in metas:
        content = a["content"].strip(SPACE) if "content" in a else None
        if "name" in a:
            first_name.setdefault(a["name"], content)
        if "property" in a:
            first_property.setdefault(a["property"], content)
    out = {
        "title": title,
        "description": first_name.get("description"),
        "canonical": canon[0] if canon else None,
        "canonicals": [c for c in canon if c is not None],
        "headings": [{"level": k, "text": t.strip(SPACE)} for k, t in sorted(headings, key=lambda h: h[0])],
        "images": images,
        "properties": list(first_property.items()),
        "names": list(first_name.items()),
        "links": links,
        "resources": by_kind["src"] + by_kind["data"] + by_kind["href"],
        "text_bytes": text_bytes,
        "html_bytes": len(page.encode("utf-8", "replace")),
        "content_tags": tags,
    }
    return out | _addresses(out, url)


def _addresses(f: dict, url: str | None) -> dict:
    """What the rules on canonical links need to know of the addresses."""
    page = urls.parsed(url)
    absolute = urls.parse(f["canonical"]) if f["canonical"] is not None else None
    resolved = urls.parse(f["canonicals"][0], page) if f["canonicals"] and page else None
    return {
        "scheme": page.scheme if page else None,
        "host": page.host if page else None,
        "canonical_readable": absolute is not None,
        "canonical_host": absolute.host if absolute else None,
        "resolved": resolved.text() if resolved else None,
        "resolved_host": resolved.host if resolved else None,
        "resolved_same": None if not resolved or not page else (resolved.path, resolved.query, resolved.fragment) == (page.path, page.query, page.fragment),
    }


def extract(pages: DataFrame, keep: list[str], html_column: str = "html", url_column: str = "url") -> DataFrame:
    """``keep`` columns of ``pages`` with a ``facts`` struct; the html itself goes no further."""
    kept = [c for c in dict.fromkeys([*keep, url_column])]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [facts(h, u) for h, u in zip(b.column("__html").to_pylist(), b.column(url_column).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(found, _TYPE)], names=[*kept, "facts"])

    return pages.select(*kept, pages[html_column].alias("__html")).mapInArrow(run, f"{fields}, facts {FACTS}")
