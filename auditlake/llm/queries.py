"""Queries of the text problems and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import encoding, leaks, mixing, quality, residue, terms
from auditlake.sources.tables import spread, table

TERM_FIELDS = ["check_id", "severity", "category"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id): captures that show template leftovers, filler, an error message or a call for scripts."""
    return residue.residue_pages(spread(table(spark, sf_dir, "page").select("page_id", "url", "html"))).select("page_id")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the kinds of residue found."""
    return residue.residue_pages(spread(table(spark, sf_dir, "page").select("page_id", "url", "html")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id): captures with text that was decoded with the wrong encoding."""
    return encoding.damaged_pages(spread(table(spark, sf_dir, "page").select("page_id", "html", "headers")))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the chain found and the restored html, null where the text is lost."""
    return encoding.damaged_pages(spread(table(spark, sf_dir, "page").select("page_id", "html", "headers")), with_text=True)


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, n_findings, n_reports, mark) of every distinct term."""
    counts, total = terms.term_frequencies(table(spark, sf_dir, "finding"), "report_id", "finding_id", TERM_FIELDS)
    return terms.mark(counts, total).withColumnsRenamed({"n_items": "n_findings", "n_records": "n_reports"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, mark) of the terms that are too rare or too common."""
    return p3_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that hold part of a test item's passage word for word."""
    return leaks.verbatim_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_item"))


def p7_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document passages that come near a test item, with word-order and answer checks."""
    return leaks.paraphrases(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_item"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, slot, source, block, epoch, doc_id, start, n_tokens): the mixed selection."""
    return mixing.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the selection reached, by source."""
    return mixing.shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios and the nearest profile of every document."""
    return quality.text_statistics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): texts that are mostly a list, a table or junk."""
    return quality.text_statistics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), found_only=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_kinds, p2_found, p2_restored, p3_found, p3_terms, p7_found, p7_paraphrases, p8_mixture, p8_shares, p9_found, p9_statistics)}

_TERMS = """WITH f AS (SELECT DISTINCT finding_id, report_id, check_id, severity, category FROM finding),
u AS (SELECT finding_id, report_id, 'check_id' AS field, check_id AS v FROM f UNION ALL SELECT finding_id, report_id, 'severity', severity FROM f UNION ALL SELECT finding_id, report_id, 'category', category FROM f),
t AS (SELECT finding_id, report_id, field, lower(trim(v, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS term FROM u),
c AS (SELECT field, term, count(DISTINCT finding_id) AS n_findings, count(DISTINCT report_id) AS n_reports FROM t WHERE term <> '' GROUP BY field, term),
m AS (SELECT *, CASE WHEN n_reports < 3 THEN 'rare' WHEN n_reports > 0.3 * (SELECT count(DISTINCT report_id) FROM finding) THEN 'common' END AS mark FROM c)
"""

_TAGS = r"'</?[a-zA-Z!][^<>]*>'"
_WORDS = "regexp_extract_all(lower(regexp_replace(TEXT, " + _TAGS + r", ' ', 'g')), '[\p{L}\p{N}]+')"


def _grams(table_name: str, key: str, text: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i + 1 : i + {leaks.RUN}], ' ') AS g FROM (SELECT {key}, w, unnest(range(len(w) - {leaks.RUN - 1})) AS i FROM (SELECT {key}, {_WORDS.replace('TEXT', text)} AS w FROM {table_name} WHERE {text} IS NOT NULL) WHERE len(w) >= {leaks.RUN})"


SQL = {
    "p7_found": f"SELECT DISTINCT d.doc_id, e.item_id FROM ({_grams('documents', 'doc_id', 'text')}) d JOIN ({_grams('eval_item', 'item_id', 'passage')}) e ON e.g = d.g",
    "p3_terms": _TERMS + "SELECT * FROM m",
    "p3_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
}
