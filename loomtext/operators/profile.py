"""Profiles of corpora: counts, distributions, quantiles, duplicates, leakage of labels. All exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import text as X

# Terms of the two taxonomies.
MBTI_TERMS = r"(?i)\b(mbti|myers[- ]?briggs|introvert(ed)?|extra[vo]ert(ed)?|introversion|extra[vo]ersion|cognitive functions?)\b"
OCEAN_TERMS = r"(?i)\b(big five|ocean|openness|conscientiousness|extraversion|extroversion|agreeableness|neuroticism)\b"
TERM_PATTERNS = {
    "mbti": r"(?i)\bmbti\b",
    "myers-briggs": r"(?i)\bmyers[- ]?briggs\b",
    "introvert": r"(?i)\bintrovert(ed)?\b",
    "extravert": r"(?i)\bextra[vo]ert(ed)?\b",
    "introversion": r"(?i)\bintroversion\b",
    "extraversion": r"(?i)\bextra[vo]ersion\b",
    "big five": r"(?i)\b(big five|ocean)\b",
}


def length_profile(df: DataFrame, value: Column, by: list[Column]) -> DataFrame:
    """Minimum, nearest-rank quantiles, mean and maximum of an integer value by group."""
    quantiles = {f"p{round(q * 100)}": F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)").cast("bigint") for q in (0.25, 0.75, 0.9, 0.95, 0.99)}
    named = [b.alias(f"g{k}") for k, b in enumerate(by)]
    grouped = df.select(*named, value.cast("bigint").alias("v")).where("v IS NOT NULL").groupBy(*(f"g{k}" for k in range(len(by))))
    return grouped.agg(
        F.count("*").alias("n"),
        F.min("v").alias("least"),
        F.floor(F.expr("percentile(v, 0.5)")).alias("median"),
        F.round(F.avg("v"), 2).alias("mean"),
        F.max("v").alias("most"),
        *(c.alias(k) for k, c in quantiles.items()),
    )


def distribution(df: DataFrame, label: Column) -> DataFrame:
    """(label, n, pct): classes with their shares."""
    counts = df.select(label.alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(whole)).select("label", "n", L.percent(F.col("n"), F.col("total")).alias("pct"))  # one row


def imbalance(dist: DataFrame) -> DataFrame:
    """(total, classes, majority, minority, ratio); of equally frequent classes the first in order."""
    return dist.agg(
        F.sum("n").alias("total"),
        F.count("*").alias("classes"),
        F.min_by("label", F.struct((-F.col("n")).alias("a"), F.col("label").alias("b"))).alias("majority"),
        F.min_by("label", F.struct(F.col("n").alias("a"), F.col("label").alias("b"))).alias("minority"),
        F.round(F.max("n") / F.min("n"), 2).alias("ratio"),
    )


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """(rows, distinct, repeated, rows_in_repeats) of a key."""
    counts = df.select(key.alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("c"))
    return counts.agg(F.sum("c").alias("rows"), F.count("*").alias("distinct"), F.count_if(F.expr("c > 1")).alias("repeated"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("rows_in_repeats"))


def leakage_stats(df: DataFrame, text: str = "text", label: str = "label_mbti") -> DataFrame:
    """How many texts mention a type, their own type, a taxonomy term, a URL or a user."""
    t = F.col(text)
    own = F.transform(F.regexp_extract_all(t, F.lit(X.TYPE_MENTION), F.lit(1)), F.upper)
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(t.rlike(X.TYPE_MENTION)).alias("any_type"),
        F.count_if(F.array_contains(own, F.upper(F.col(label)))).alias("own_type"),
        F.count_if(t.rlike(MBTI_TERMS)).alias("mbti_terms"),
        F.count_if(t.rlike(OCEAN_TERMS)).alias("ocean_terms"),
        F.count_if(t.rlike("(?i)" + X.URL)).alias("urls"),
        F.count_if(t.rlike(X.MENTION)).alias("mentions"),
    )


def term_breakdown(df: DataFrame, by: Column, text: str = "text") -> DataFrame:
    """(group, term, n): texts that hold each term, counted in one pass."""
    counted = df.groupBy(by.alias("grp")).agg(*(F.count_if(F.col(text).rlike(p)).alias(k) for k, p in TERM_PATTERNS.items()))
    return counted.unpivot("grp", list(TERM_PATTERNS), "term", "n")


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, r) of each pair of columns, over the rows that have both; null below two rows or without variance."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    wide = df.agg(*(F.struct(F.count_if(both(a, b)).alias("n"), F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias("r")).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`.n").alias("n"), F.round(F.col(f"`{a}|{b}`.r"), 6).alias("r")) for a, b in pairs)))
    return wide.select(rows.alias("p")).select("p.*")


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): one grouping-sets pass over all fields; <missing> for null."""
    filled = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(c) for c in columns))
    return filled.unpivot([], columns, "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


def log_histogram(df: DataFrame, value: Column, bins: int, top: float) -> DataFrame:
    """(bin, n): counts in bins of equal width of the logarithm from 1 to `top`; bin bins + 1 lies above."""
    v = df.select(value.cast("double").alias("v")).where("v >= 1")
    return v.select(F.width_bucket(F.log10("v"), F.lit(0.0), F.log10(F.lit(float(top))), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def dataset_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, hash): order-free; the sum of the rows' 64-bit hashes of canonical JSON, in hexadecimal digits of its MD5."""
    row = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))
    number = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.md5(F.coalesce(F.sum(number), F.lit(0)).cast("string")).alias("hash"))


def combined(df: DataFrame, by: str) -> DataFrame:
    """(by, n, n_texts, n_labelled, n_split, mean_chars, most_words, repeated, english): a profile of each corpus.

    Counts of one grain come from one pass; repeated texts from the counts of their hashes.
    """
    once = df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(X.strip("text") != "").alias("n_texts"),
        F.count("label_mbti").alias("n_labelled"),
        F.count("split").alias("n_split"),
        F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
        F.max(X.word_count("text")).alias("most_words"),
        F.round(F.avg(F.when(F.lower("lang") == "en", 1.0).otherwise(0.0)), 6).alias("english"),
    )
    hashes = df.groupBy(by, F.md5(F.coalesce("text", F.lit(""))).alias("k")).agg(F.count("*").alias("c")).groupBy(by).agg(F.sum(F.col("c") - 1).alias("repeated"))
    joined = once.alias("o").join(hashes.alias("h"), F.expr(f"o.{by} <=> h.{by}"))
    return joined.select(f"o.{by}", "n", "n_texts", "n_labelled", "n_split", "mean_chars", "most_words", "repeated", "english")
