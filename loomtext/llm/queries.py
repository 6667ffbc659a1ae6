"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, budget, garble, language, neardup, overlap, packing, pii
from loomtext.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


def _repairs(spark: SparkSession, d: str) -> DataFrame:
    return garble.repairs(table(spark, d, "documents", True))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return written(_repairs(spark, d).select("doc_id"), "garbled")


def _identified(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", True)
    best = language.restored_texts(docs, written(_repairs(spark, d), "repairs"))
    return language.identify(best, table(spark, d, "lang_codes"), "best_text")


def p1_budget(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_budget(table(spark, d, "documents", True), table(spark, d, "lang_codes"))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    return budget.budget_totals(p1_budget(spark, d))


def p1_tokens(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_counts(table(spark, d, "documents", True).select("doc_id", "text")).select("doc_id", "n_tokens")


def p1_slices(spark: SparkSession, d: str) -> DataFrame:
    sliced = budget.with_slices(table(spark, d, "documents", True).select("text", "source", "lang", "domain_name"), table(spark, d, "lang_codes"))
    return sliced.groupBy(F.col("slice_source").alias("source"), F.col("slice_lang").alias("lang"), F.col("slice_domain").alias("domain")).agg(F.count("*").alias("n_docs"), F.count("text").alias("n_texts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.findings(table(spark, d, "documents", True)).select("doc_id", "kind", "start_char")


def p2_sanitised(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", True)
    return pii.sanitised(docs, pii.findings(docs))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "documents", True), 3, 0.5, 40, _garbled(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "documents", True), 3, 0.5, 40, _garbled(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping_pairs(table(spark, d, "documents", True), without=_garbled(spark, d))


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return overlap.overlapping_classes(table(spark, d, "documents", True), without=_garbled(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.class_report(table(spark, d, "documents"), *_overlaps(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.class_members(*_overlaps(spark, d))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    links, _ = _overlaps(spark, d)
    return links.select(F.col("a").alias("held_out_class"), F.col("b").alias("train_class"), "shared", F.col("n_a").alias("n_spans"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.covered_records(table(spark, d, "documents", True), without=_garbled(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_cases(_identified(spark, d))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return _identified(spark, d).select("doc_id", "lang", "confidence", "n_tokens")


def p5_passages(spark: SparkSession, d: str) -> DataFrame:
    return _identified(spark, d).select("doc_id", F.explode("passages").alias("p")).select("doc_id", "p.start_char", "p.end_char", "p.lang", "p.n_tokens", "p.confidence")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents", True))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents", True), table(spark, d, "pack_specs"))


def p7_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p7_containers(spark, d), table(spark, d, "pack_specs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _repairs(spark, d).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return _repairs(spark, d).select("doc_id", "restored", F.array_join("errors", ", ").alias("errors"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            *(p1_budget, p1_totals, p1_tokens, p1_slices, p2_found, p2_sanitised, p3_found, p3_groups, p4_found, p4_report, p4_classes, p4_links, p4_coverage),
            *(p5_found, p5_documents, p5_passages, p6_ids, p7_containers, p7_utilisation, p8_found, p8_restored),
        )
    }


def oracle_sql() -> dict[str, str]:
    trim = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    return {
        "p1_slices": rf"""
            WITH names AS (
                SELECT DISTINCT lower(trim(n)) AS k, lower(trim(code)) AS c
                FROM (SELECT code, unnest([code, code3, english_name]) AS n FROM lang_codes) WHERE n IS NOT NULL AND code IS NOT NULL),
            d AS (SELECT text,
                regexp_replace(lower({trim.format("source")}), '[\s-]+', '_', 'g') AS s,
                regexp_replace(lower({trim.format("domain_name")}), '^/?r/\s*', '') AS o,
                regexp_extract(lower({trim.format("lang")}), '^[^-_]*') AS l FROM documents)
            SELECT coalesce(nullif(s, ''), 'unknown') AS source, coalesce(c, 'unknown') AS lang, coalesce(nullif(o, ''), 'unknown') AS domain,
                count(*) AS n_docs, count(text) AS n_texts
            FROM d LEFT JOIN names ON l = k GROUP BY ALL""",
    }
