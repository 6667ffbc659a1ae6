"""Deterministic splits and samples: an order by MD5 stands where a random generator would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified_split(df: DataFrame, key: Column, stratum: Column, held_out: float = 0.3) -> DataFrame:
    """df with `part`: of each stratum the first share by MD5 is held out, half of it val and half test.

    Every stratum is cut at its own size, so shares are exact to one row. Ranks within a stratum are found by counting
    per hash bucket first: no stratum is sorted in one task.
    """
    h = F.md5(key.cast("string"))
    base = df.withColumns({"_h": h, "_s": F.coalesce(stratum, F.lit("<null>")), "_b": F.substring(h, 1, 2)})
    buckets = base.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    over = Window.partitionBy("_s").orderBy("_b")
    offsets = buckets.select("_s", "_b", (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_s")).alias("_total"))
    ranked = base.join(offsets, ["_s", "_b"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key)))
    cut, half = F.ceil(F.col("_total") * held_out), F.ceil(F.ceil(F.col("_total") * held_out) / 2)
    part = F.when(F.col("_rank") <= half, "val").when(F.col("_rank") <= cut, "test").otherwise("train")
    return ranked.withColumn("part", part).drop("_h", "_s", "_b", "_before", "_total", "_rank")


def capped_sample(df: DataFrame, by: list[str], key: Column, cap: int) -> DataFrame:
    """At most `cap` rows of each group, those whose key's MD5 comes first; limited before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(F.md5(key.cast("string")), key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_rank")


def sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    return df.orderBy(F.md5(key.cast("string")), key).limit(n)


def cross_split_counts(df: DataFrame, split: Column, key: Column) -> DataFrame:
    """(split_a, split_b, shared): distinct keys that two splits have in common, from one grouping by key."""
    sets = df.select(split.alias("s"), key.alias("k")).where("s IS NOT NULL AND k IS NOT NULL").groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("all"))
    first = sets.where("size(all) > 1").select(F.posexplode("all").alias("i", "split_a"), "all")
    pairs = first.select("split_a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("split_b"))
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def stratum(df: DataFrame, label: str, fallback: str, least: int = 2) -> DataFrame:
    """df with `stratum`: the label where every label has `least` rows or more, else none; rows without one fall back."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count()
    enough = counts.agg((F.coalesce(F.min("count"), F.lit(0)) >= least).alias("_ok"), F.count("*").alias("_k"))
    joined = df.join(F.broadcast(enough))  # one row
    own = F.coalesce(F.col(label), F.concat(F.lit(fallback + "_"), F.coalesce(F.col(fallback), F.lit("none"))))
    return joined.withColumn("stratum", F.when(F.col("_ok") & (F.col("_k") > 1), own).otherwise("all")).drop("_ok", "_k")


def from_cache(df: DataFrame, key: Column, cache: DataFrame, value: str, otherwise: str) -> DataFrame:
    """df with `value` looked up in cache (key, value), else the column `otherwise`; the cache has one row for each key."""
    kept = cache.groupBy("key").agg(F.min("value").alias("_v"))
    return df.withColumn("_key", key).join(kept.withColumnRenamed("key", "_key"), "_key", "left").withColumn(value, F.coalesce("_v", F.col(otherwise))).drop("_key", "_v")
