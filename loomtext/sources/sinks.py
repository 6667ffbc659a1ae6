"""Writers of records, chunks, evidence, metrics and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_records(records: DataFrame, folder: str) -> None:
    """One folder of JSON Lines for each split."""
    records.write.partitionBy("split").mode("overwrite").json(folder)


def gold_evidence(records: DataFrame) -> DataFrame:
    """(id, evidence) of the records that have evidence."""
    return records.where("size(evidence) > 0").select("id", "evidence")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """chunks with embed_text falling back to text."""
    return chunks.withColumn("embed_text", F.coalesce(F.nullif("embed_text", F.lit("")), F.col("text")))


def append_missing(rows: DataFrame, done: DataFrame, key: str, folder: str) -> None:
    """Appends the rows whose key isn't written yet: what an interrupted run left over."""
    rows.join(done.select(key).distinct(), key, "left_anti").write.mode("append").json(folder)


def sorted_json(df: DataFrame) -> DataFrame:
    """(json): each row with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def kb_views(chunks: DataFrame) -> dict[str, DataFrame]:
    """The full knowledge base, those for either framework, and the examples."""
    return {
        "full": chunks,
        "ocean": chunks.where("framework IN ('ocean', 'both')"),
        "mbti": chunks.where("framework IN ('mbti', 'both')"),
        "examples": chunks.where("category IN ('few_shot_example', 'evidence_mapping_example')"),
    }


def evaluation_form(predictions: DataFrame, columns: int = 3, length: int = 500) -> DataFrame:
    """(blind_id, snippet, evidence_1 ..., predicted): rows for human judges; the id is a digest, not the record's."""
    quotes = [F.coalesce(F.get("evidence", F.lit(k)), F.lit("")).alias(f"evidence_{k + 1}") for k in range(columns)]
    return predictions.select(F.substring(F.md5(F.col("id").cast("string")), 1, 8).alias("blind_id"), F.substring("text", 1, length).alias("snippet"), *quotes, "predicted")


def prediction_file(rows: DataFrame, folder: str, model: str, dataset: str, task: str) -> None:
    """Predictions as <model>_<dataset>_<task>.jsonl."""
    rows.select("id", "text", "gold_label", "predicted_label").write.mode("overwrite").json(f"{folder}/{model}_{dataset}_{task}.jsonl")


def metric_rows(metrics: DataFrame, run: str, prefix: str, step: int) -> DataFrame:
    """(run, key, step, value): one row for each numeric column, keys with their prefix."""
    kept = [c for c, t in metrics.dtypes if t in ("double", "bigint", "int", "float")]
    cast = metrics.select(*(F.col(c).cast("double").alias(c) for c in kept))
    return cast.unpivot([], kept, "key", "value").select(F.lit(run).alias("run"), F.concat(F.lit(prefix + "/"), "key").alias("key"), F.lit(step).alias("step"), "value")


def manifest(chunks: DataFrame) -> DataFrame:
    """(n_chunks, n_sources, categories JSON, hash): the hash doesn't depend on the order of rows."""
    row = F.to_json(F.struct(*sorted(c for c in chunks.columns)))
    part = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")
    whole = chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("source_id").alias("n_sources"), F.md5(F.coalesce(F.sum(part), F.lit(0)).cast("string")).alias("hash"))
    per = chunks.groupBy("category").agg(F.count("*").alias("n"))
    listed = per.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("category", F.lit("<missing>")), "n"))))).alias("categories"))  # categories are few
    return whole.join(F.broadcast(listed))  # one row each
