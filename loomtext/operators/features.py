"""Vocabulary, TF-IDF and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X


def vocabulary(docs: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(word, id): the size - 2 most frequent words, ids from 2; 0 is padding and 1 anything else.

    Words are ordered by count, then by themselves. The result has a fixed bound, which makes the ranking window small.
    """
    counts = docs.select(F.explode(X.words(F.lower(text_col))).alias("word")).groupBy("word").count()
    top = counts.orderBy(F.desc("count"), "word").limit(size - 2)
    return top.select("word", (F.row_number().over(Window.orderBy(F.desc("count"), "word")) + 1).alias("id"))


def encode_with_vocabulary(docs: DataFrame, size: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the ids of the first `length` words, filled up with 0; null and empty texts are all 0."""
    first = docs.select(id_col, F.posexplode(F.slice(X.words(F.lower(text_col)), 1, length)).alias("pos", "word"))
    known = first.join(F.broadcast(vocabulary(docs, size, text_col)), "word", "left")  # at most `size` rows
    listed = known.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(1)).alias("id")))).alias("all"))
    ids = F.coalesce(F.transform("all", lambda x: x["id"]), F.expr("cast(array() as array<int>)"))
    return docs.select(id_col).join(listed, id_col, "left").select(id_col, F.concat(ids, F.array_repeat(F.lit(0), length - F.size(ids))).alias("ids"))


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df: int = 3, max_df: float = 0.95) -> DataFrame:
    """(id_col, term, weight): L2-normed (1 + ln tf) (ln((1 + n) / (1 + df)) + 1) of words and word pairs."""
    t = F.col("_t")
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.expr("cast(array() as array<string>)"))
    whole = docs.where(F.col(text_col).isNotNull()).select(id_col, X.tokens(text_col).alias("_t"))
    tf = whole.select(id_col, F.explode(F.concat(t, pairs)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    n = whole.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))  # n is one row
    # Spark's size estimate knows nothing of the rows that explode adds, and would send all terms to the driver
    weighted = tf.join(df.hint("merge"), "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, balanced, sqrt_balanced, sampling): n/(k c), its square root within 0.5 and 2, and 1/c."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    b = F.col("total") / (F.col("k") * F.col("n"))
    return counts.join(F.broadcast(whole)).select("label", "n", F.round(b, 6).alias("balanced"), F.round(F.least(F.greatest(F.sqrt(b), F.lit(0.5)), F.lit(2.0)), 6).alias("sqrt_balanced"), F.round(1 / F.col("n"), 6).alias("sampling"))
