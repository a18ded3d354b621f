"""Nested reports to flat, linked tables.

The JVM parses each report once into a VARIANT and casts it to nested columns. Those reach Python as
Arrow list arrays; child tables are cut from the buffers with list offsets and parent indices, and
keys follow by a vectorised ``take``. No row is visited one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "struct<check_id:string,category:string,severity:string,message:string,penalty:string>"
#: Layers of JSON strings and envelopes taken off by plain columns; a loop takes off any beyond them.
PLAIN_WRAPS = 3


def _parse(text: str) -> str:
    """One complete JSON value; in brackets, so that anything after the value makes it invalid."""
    return f"try_variant_get(try_parse_json(concat('[', {text}, ']')), '$', 'array<variant>')"


def _value(parsed: str) -> str:
    return f"CASE WHEN size({parsed}) = 1 THEN get({parsed}, 0) END"


def _unwrapped(text: str, blank: str) -> str:
    """Pages of a report that is still wrapped: takes off a layer a step, as many as the text can hold."""
    value = f"get({_parse('s.t')}, 0)"
    has_pages = "try_variant_get(s.v, '$.pages', 'array<variant>') IS NOT NULL OR try_variant_get(s.v, '$.report.pages', 'array<variant>') IS NOT NULL"
    inner = f"trim(BOTH {blank} FROM CASE WHEN startswith(s.t, '\"') THEN try_variant_get(s.v, '$', 'string') ELSE try_variant_get(s.v, '$.report', 'string') END)"
    read = f"transform(array(s), s -> named_struct('t', s.t, 'v', CASE WHEN size({_parse('s.t')}) = 1 THEN {value} END))[0]"
    step = f"transform(array({read}), s -> CASE WHEN s.v IS NULL THEN named_struct('t', CAST(NULL AS STRING), 'v', s.v) WHEN {has_pages} THEN s ELSE named_struct('t', {inner}, 'v', CAST(NULL AS VARIANT)) END)[0]"
    loop = f"aggregate(sequence(1, length({text}) div 2 + 1), named_struct('t', {text}, 'v', CAST(NULL AS VARIANT)), (s, i) -> CASE WHEN s.t IS NULL OR s.v IS NOT NULL THEN s ELSE {step} END, s -> coalesce(try_variant_get(s.v, '$.pages', 'array<variant>'), try_variant_get(s.v, '$.report.pages', 'array<variant>')))"
    return f"CASE WHEN {text} IS NOT NULL THEN {loop} END"


def decode_reports(runs: DataFrame, text: str = "report", wraps: int = PLAIN_WRAPS) -> DataFrame:
    """Replace the JSON column ``text`` by ``pages``; unreadable reports get null.

    A report is readable if it is complete JSON, perhaps after a byte-order mark, as a JSON string or
    in an envelope ``{"report": ...}``, however many of them lie around it, and has a list of pages.
    A filter on ``pages`` would be pushed into the unwrapping steps and copy them, so callers filter
    after a Python stage or a written table. In ``pages`` a null or non-object entry stays as null in its place. ``findings`` may be a lone object;
    ``category_scores`` a map or a list of ``{category, score}``; scores without a value are left out.
    Null, empty or broken text is unreadable. Of a repeated key in one object the last one counts.
    """
    runs.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    blank = r"' \t\r\n\u000b\u000c﻿'"
    df = runs.withColumn("__t", F.expr(f"trim(BOTH {blank} FROM {text})")).drop(text)
    df = df.withColumn("__pages", F.expr("CAST(NULL AS array<variant>)"))
    for _ in range(wraps):
        df = df.withColumn("__a", F.expr(f"CASE WHEN __pages IS NULL THEN {_parse('__t')} END"))
        df = df.withColumn("__v", F.expr(_value("__a"))).drop("__a")
        df = df.withColumn("__p", F.expr("coalesce(__pages, try_variant_get(__v, '$.pages', 'array<variant>'), try_variant_get(__v, '$.report.pages', 'array<variant>'))")).drop("__pages")
        inner = F.expr(
            "CASE WHEN __p IS NULL AND __v IS NOT NULL THEN CASE WHEN startswith(__t, '\"') THEN try_variant_get(__v, '$', 'string') ELSE try_variant_get(__v, '$.report', 'string') END END"
        )
        df = df.withColumn("__n", inner).drop("__v", "__t")
        df = df.withColumn("__t", F.expr(f"trim(BOTH {blank} FROM __n)")).drop("__n").withColumnRenamed("__p", "__pages")
    df = df.withColumn("__pages", F.coalesce("__pages", F.expr(_unwrapped("__t", blank))))
    entry = F.expr("transform(__pages, x -> try_variant_get(x, '$', 'struct<url:string,score:string,findings:variant,category_scores:variant>'))")
    df = df.withColumn("__e", entry).drop("__pages", "__t")
    return df.withColumn("pages", F.transform("__e", _page)).drop("__e")


def _page(e: Column) -> Column:
    f, s = e["findings"], e["category_scores"]
    listed = F.transform(F.try_variant_get(f, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", FINDING))
    alone = F.try_variant_get(f, "$", FINDING)
    pairs = F.try_variant_get(s, "$", "array<struct<category:string,score:string>>")
    mapped = F.transform(
        F.map_entries(F.try_variant_get(s, "$", "map<string,string>")),
        lambda x: F.struct(x["key"].alias("category"), x["value"].alias("score")),
    )
    given = F.filter(F.coalesce(pairs, mapped), lambda x: x["category"].isNotNull() & x["score"].isNotNull())
    return F.when(
        e.isNotNull(),
        F.struct(
            e["url"].alias("url"),
            e["score"].alias("score"),
            F.coalesce(listed, F.when(alone.isNotNull(), F.array(alone))).alias("findings"),
            given.alias("scores"),
        ),
    )


# --- Arrow kernels -----------------------------------------------------------------------------


def unnest(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Parent index, value and position of every element of a list array; null lists have none."""
    parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    return parents, pc.list_flatten(lists), np.arange(len(parents)) - starts[parents]


def _valid(parents: np.ndarray, values: pa.Array, at: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    keep = pc.is_valid(values).to_numpy(zero_copy_only=False)
    return (parents, values, at) if keep.all() else (parents[keep], values.filter(pa.array(keep)), at[keep])


def _field(structs: pa.Array, name: str) -> pa.Array:
    """A struct's field with the struct's own nulls applied."""
    return pc.struct_field(structs, name)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("run_id")
        run_of, pages, page_no = _valid(*unnest(batch.column("pages")))
        out = [(run_of, page_no, "page", pa.array([""], pa.string()).take(pa.array(np.zeros(len(run_of), np.int64))))]
        page_of, _, at = _valid(*unnest(_field(pages, "findings")))
        out.append((run_of[page_of], page_no[page_of], "finding", pc.cast(pa.array(at), pa.string())))
        page_of, scores, _ = _valid(*unnest(_field(pages, "scores")))
        out.append((run_of[page_of], page_no[page_of], "score", pc.cast(_field(scores, "category"), pa.string())))
        for parent, no, kind, item in out:
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(parent)), pa.array(no.astype(np.int32)), pa.array([kind], pa.string()).take(pa.array(np.zeros(len(no), np.int64))), item],
                names=["run_id", "page_no", "kind", "item"],
            )


def report_items(decoded: DataFrame) -> DataFrame:
    """(run_id, page_no, kind, item) of every page, finding and score of ``decoded`` (run_id, pages)."""
    return decoded.select("run_id", "pages").mapInArrow(_items, "run_id bigint, page_no int, kind string, item string")


def _whole(text: pa.Array) -> pa.Array:
    """Scores and penalties as integers; text that is no number becomes null."""
    ok = pc.match_substring_regex(text, r"^\s*-?\d{1,9}(\.\d+)?\s*$")
    number = pc.cast(pc.utf8_trim_whitespace(pc.if_else(ok, text, pa.scalar(None, pa.string()))), pa.float64())
    return pc.cast(pc.round(number), pa.int32())


def _flat(level: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("run_id")
            run_of, pages, page_no = _valid(*unnest(batch.column("pages")))
            if level == "pages":
                cols = {"url": _field(pages, "url"), "score": _whole(_field(pages, "score"))}
                runs, nos = run_of, page_no
            else:
                page_of, items, at = _valid(*unnest(_field(pages, level)))
                runs, nos = run_of[page_of], page_no[page_of]
                if level == "findings":
                    cols = {"finding_no": pa.array(at.astype(np.int32))} | {k: _field(items, k) for k in ("check_id", "category", "severity", "message")} | {"penalty": _whole(_field(items, "penalty"))}
                else:
                    cols = {"category": _field(items, "category"), "score": _whole(_field(items, "score"))}
            yield pa.RecordBatch.from_pydict({"run_id": ids.take(pa.array(runs)), "page_no": pa.array(nos.astype(np.int32))} | cols)

    return emit


LEVELS = {
    "pages": "run_id bigint, page_no int, url string, score int",
    "findings": "run_id bigint, page_no int, finding_no int, check_id string, category string, severity string, message string, penalty int",
    "scores": "run_id bigint, page_no int, category string, score int",
}


def flat_table(decoded: DataFrame, level: str) -> DataFrame:
    """One child table (``pages``, ``findings`` or ``scores``), keyed by run_id and page_no."""
    return decoded.select("run_id", "pages").mapInArrow(_flat(level), LEVELS[level])


def flatten_reports(runs: DataFrame) -> dict[str, DataFrame]:
    """Tables runs, pages, findings and scores; children name their parent by run_id and page_no.

    ``runs`` has id, host, root_url, site_score, crawled_at and report, one row per id.
    """
    decoded = decode_reports(runs.withColumnRenamed("id", "run_id"))
    top = decoded.select("run_id", "host", "root_url", "site_score", "crawled_at", F.col("pages").isNotNull().alias("readable"), F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"))
    return {"runs": top.withColumn("n_pages", F.greatest("n_pages", F.lit(0)))} | {k: flat_table(decoded, k) for k in LEVELS}
