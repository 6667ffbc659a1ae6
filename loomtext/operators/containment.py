"""Which strings stand verbatim in which texts, without comparing every string with every text.

A string of at least `length` characters can only stand where its first `length` characters do, so these are joined
with the texts' substrings of that length by their hash, and the matches are verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as X

LENGTH = 30


def contained(strings: DataFrame, texts: DataFrame, string_id: str, string: str, text_id: str, text: str, length: int = LENGTH) -> DataFrame:
    """(string_id, text_id): strings of at least `length` characters, white space squeezed, that stand in a text.

    The texts are the side that is cut up, so they should be the smaller one. Null and short strings match nothing.
    """
    s = strings.select(string_id, X.squeeze(string).alias("_s")).where(F.length("_s") >= length).withColumn("_key", F.xxhash64(F.substring("_s", 1, length)))
    t = texts.select(text_id, X.squeeze(text).alias("_t")).where(F.length("_t") >= length)
    grams = F.transform(F.sequence(F.lit(1), F.length("_t") - length + 1), lambda i: F.xxhash64(F.substring(F.col("_t"), i, F.lit(length))))
    keys = t.select(text_id, F.explode(F.array_distinct(grams)).alias("_key"))
    return s.join(keys, "_key").join(t, text_id).where(F.contains("_t", "_s")).select(string_id, text_id)
