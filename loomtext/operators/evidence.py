"""Evidence sentences: scores and the best ones of each text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X


def scored_sentences(docs: DataFrame, lexicon: tuple[str, ...] = X.LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sentence_idx, sentence, score, matched): null and empty texts have no sentences."""
    each = docs.select(id_col, F.posexplode(X.sentences(text_col)).alias("sentence_idx", "sentence")).withColumn("own", F.array_distinct(X.tokens("sentence")))
    hit = each.withColumn("hits", F.array_intersect("own", F.array(*map(F.lit, lexicon))))
    score = F.least(F.lit(1.0), 10.0 * F.size("hits") / F.greatest(F.size("own"), F.lit(1)))
    return hit.select(id_col, F.col("sentence_idx").cast("bigint").alias("sentence_idx"), "sentence", score.alias("score"), F.array_join(F.array_sort("hits"), " ").alias("matched"))


def top_sentences(scored: DataFrame, k: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The k best sentences of each text; ties keep the order of the text."""
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "sentence_idx")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def blended(supervised: DataFrame, keyword: DataFrame, alpha: float = 0.7, keys: tuple[str, ...] = ("doc_id", "sentence_idx")) -> DataFrame:
    """supervised with score = alpha supervised + (1 - alpha) keyword; a missing keyword score is 0."""
    other = keyword.select(*keys, F.col("score").alias("other"))
    joined = supervised.join(other, list(keys), "left")
    return joined.withColumn("score", alpha * F.col("score") + (1 - alpha) * F.coalesce("other", F.lit(0.0))).drop("other")


def with_eligibility(scored: DataFrame, least: int = 4) -> DataFrame:
    """scored with `eligible`: sentences of fewer than `least` words stay, with score 0."""
    ok = X.word_count("sentence") >= least
    return scored.withColumns({"eligible": ok, "score": F.when(ok, F.col("score")).otherwise(0.0)})
