"""Queries of glossaries, caches, strata and training curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import metrics, sampling
from loomtext.plans.analysis_queries import _SUMMARY, _report_sql, metrics_by_source
from loomtext.plans.catalogue import register
from loomtext.session import table

GLOSSARY = {"我的": "my ", "我": "I ", "厨房": "kitchen ", "一个": "one ", "同事": "colleague "}


def _sql_glossed(x: str) -> str:
    for term in sorted(GLOSSARY, key=lambda t: (-len(t), t)):
        x = f"replace({x}, '{term}', '{GLOSSARY[term]}')"
    return x


@register("glossary_residue", f"SELECT dialogue_id, count(*) AS n, sum(len(regexp_extract_all({_sql_glossed('utterance')}, '[一-鿿]')))::BIGINT AS residue FROM dialogue_turns WHERE utterance IS NOT NULL GROUP BY dialogue_id")
def glossary_residue(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "dialogue_turns").where("utterance IS NOT NULL")
    return turns.groupBy("dialogue_id").agg(F.count("*").alias("n"), F.sum(X.han_residue(X.glossed("utterance", GLOSSARY))).alias("residue"))


@register("cached_texts", "SELECT comment_id, ingested_at::VARCHAR IS NOT NULL AS known, coalesce(CASE WHEN substr(sha256(body), 1, 1) < '8' THEN 'cached ' || substr(body, 1, 20) END, body) AS shown FROM comments")
def cached_texts(spark: SparkSession, d: str) -> DataFrame:
    """Bodies looked up by content key in a cache that holds half of the distinct ones."""
    c = table(spark, d, "comments").select("comment_id", "body", F.col("ingested_at").isNotNull().alias("known"))
    cache = c.where("body IS NOT NULL").select(X.content_key("body").alias("key"), F.concat(F.lit("cached "), F.substring("body", 1, 20)).alias("value")).where("key < '8'")
    return sampling.from_cache(c, X.content_key("body"), cache, "shown", "body").select("comment_id", "known", "shown")


@register("strata", "WITH c AS (SELECT min(n) AS m, count(*) AS k FROM (SELECT count(*) AS n FROM documents WHERE label_mbti IS NOT NULL GROUP BY label_mbti)) SELECT CASE WHEN coalesce(m, 0) >= 2 AND k > 1 THEN coalesce(label_mbti, 'source_' || coalesce(source, 'none')) ELSE 'all' END AS stratum, count(*) AS n FROM documents, c GROUP BY 1")
def strata(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratum(table(spark, d, "documents"), "label_mbti", "source").groupBy("stratum").agg(F.count("*").alias("n"))


@register(
    "early_stopping",
    """WITH b AS (SELECT event_id, user_id, value, row_number() OVER w AS n, min(value) OVER (w ROWS UNBOUNDED PRECEDING) AS best, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, best, n - max(CASE WHEN before IS NULL OR value < before THEN n END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS waited FROM b""",
)
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    return metrics.early_stopping(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "best", "waited")


@register("flat_metrics", f"{_report_sql('source')}, s AS (SELECT source, {_SUMMARY} FROM f GROUP BY source) SELECT source || '_' || metric AS key, value FROM (UNPIVOT (SELECT source, accuracy, macro_f1 FROM s) ON accuracy, macro_f1 INTO NAME metric VALUE value)")
def flat_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.flattened(metrics_by_source(spark, d), "source", ["accuracy", "macro_f1"])
