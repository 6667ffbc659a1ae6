"""Queries that write what the tables give in the forms of raw corpora and results, and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import text as X
from loomtext.operators import corpora, knowledge
from loomtext.plans.catalogue import register
from loomtext.plans.corpus_queries import _QUOTES, _SAID
from loomtext.plans.text_queries import TYPES, sql_strip, sql_words
from loomtext.session import scratch_dir, table
from loomtext.sources import readers, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@register("splits_scan", "SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, label_mbti, split AS split_file FROM documents WHERE split IN ('train', 'val', 'test')")
def splits_scan(spark: SparkSession, d: str) -> DataFrame:
    """The files of three splits in one scan, each row with the name of its file."""
    folder = _folder(spark, "splits")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "label_mbti", "source", "split")
    for name in ("train", "val", "test"):
        docs.where(F.col("split") == name).write.json(f"{folder}/{name}.jsonl")
    return readers.splits(spark, folder).select("id", F.md5("text").alias("text_md5"), "label_mbti", "split_file")


@register("essays_latin", "SELECT authid, md5(nullif(regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g'), '')) AS text_md5, nullif(copn, '') AS copn, nullif(cneu, '') AS cneu FROM essays")
def essays_latin(spark: SparkSession, d: str) -> DataFrame:
    """Essays as a Latin-1 file, which has a question mark for every other character."""
    path = _folder(spark, "essays")
    table(spark, d, "essays").write.options(header=True, quote='"', escape='"', quoteAll=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.essays(spark, path).select("authid", F.md5("text").alias("text_md5"), "copn", "cneu")


_TOLD = "dialogue_turns WHERE speaker IS NOT NULL AND utterance IS NOT NULL AND utt_id IS NOT NULL AND dialogue_id IS NOT NULL"


def _dialogue_files(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents, one for each speaker of a dialogue, written and read."""
    path = _folder(spark, "dialogues")
    turns = table(spark, d, "dialogue_turns").where(_TOLD.partition("WHERE ")[2])
    lines = turns.groupBy("speaker", "dialogue_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("utt_id", "utterance"))), lambda x: x["utterance"]).alias("lines"))
    nested = F.create_map("speaker", F.struct(F.lit(1).alias("dlg_num"), F.create_map("dialogue_id", "lines").alias("dialogue")))
    lines.select(F.to_json(nested).alias("value")).write.text(path)
    return readers.dialogues(spark, path, whole=False)


@register("dialogue_files", f"SELECT speaker, dialogue_id, row_number() OVER (PARTITION BY speaker, dialogue_id ORDER BY utt_id, utterance) - 1 AS pos, utterance AS line FROM {_TOLD}")
def dialogue_files(spark: SparkSession, d: str) -> DataFrame:
    return _dialogue_files(spark, d).withColumn("pos", F.col("pos").cast("bigint"))


@register(
    "annotated_dialogues",
    f"""WITH t AS (SELECT speaker, dialogue_id, count(*) AS n FROM {_TOLD} GROUP BY ALL)
        SELECT e.speaker, e.dialogue_id, trait, level_raw AS level, coalesce(len(utt_ids), 0) AS n_ids, coalesce(n, 0) AS n_turns FROM dialogue_evidence e LEFT JOIN t USING (speaker, dialogue_id)
        WHERE e.dialogue_id IS NOT NULL AND trait IS NOT NULL AND e.speaker IN (SELECT speaker FROM t)""",
)
def annotated_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Annotations, read from nested documents, with the turns of their speaker in their dialogue."""
    path = _folder(spark, "annotations")
    e = table(spark, d, "dialogue_evidence").where("speaker IS NOT NULL AND dialogue_id IS NOT NULL AND trait IS NOT NULL")
    item = F.struct(F.col("level_raw").alias("level"), F.to_json("utt_ids").alias("utt_id"), "nat_lang")
    e.select(F.to_json(F.create_map("speaker", F.struct(F.create_map("dialogue_id", F.create_map("trait", item)).alias("annotation")))).alias("value")).write.text(path)
    joined = corpora.annotated_dialogues(readers.annotations(spark, path, whole=False), _dialogue_files(spark, d))
    return joined.select("speaker", "dialogue_id", "trait", "level", F.coalesce(F.size("utt_ids"), F.lit(0)).cast("bigint").alias("n_ids"), F.size("turns").cast("bigint").alias("n_turns"))


@register("kb_catalogue", "SELECT CASE WHEN length(text) % 2 = 0 THEN 'kb_' || lpad(line::VARCHAR, 5, '0') ELSE chunk_id END AS chunk_id, text, framework FROM (SELECT *, row_number() OVER (ORDER BY chunk_id) AS line FROM kb_chunks) WHERE text IS NOT NULL")
def kb_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of a source of JSON Lines, one that is missing and one of another kind; rows without an id get their line's."""
    folder = _folder(spark, "kb")
    chunks = table(spark, d, "kb_chunks")  # 240 rows at every size: one file, whose order of lines counts
    own = F.when((F.length("text") % 2 == 0), F.lit(None)).otherwise(F.col("chunk_id"))
    rows = F.to_json(F.struct(own.alias("chunk_id"), "text", F.create_map(F.lit("framework"), F.col("framework")).alias("metadata")))
    chunks.select(rows.alias("value"), F.col("chunk_id").alias("k")).coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{folder}/kb.jsonl")
    read = readers.catalogue(spark, [f"{folder}/kb.jsonl", f"{folder}/missing.jsonl", f"{folder}/kb.csv"])
    return read.select("chunk_id", "text", F.col("metadata")["framework"].alias("framework"))


@register(
    "prediction_files",
    """SELECT CASE doc_id % 2 WHEN 0 THEN 'tier1_essays_ocean_O_lr' ELSE 'tier2a_mbti_16class_nb' END AS method, CASE doc_id % 2 WHEN 0 THEN 'tier1' ELSE 'tier2a' END AS tier, CASE doc_id % 2 WHEN 0 THEN 'essays' ELSE 'mbti' END AS dataset,
        CASE doc_id % 2 WHEN 0 THEN 'O' ELSE '' END AS trait, doc_id::VARCHAR AS id, label_mbti AS gold_label, lang AS predicted_label FROM documents WHERE coalesce(label_mbti, '') <> '' AND coalesce(lang, '') <> ''""",
)
def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written by model, corpus and task, and read with what their files' names say."""
    folder = _folder(spark, "predictions")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("label_mbti").alias("gold_label"), F.col("lang").alias("predicted_label"), "doc_id")
    sinks.prediction_file(docs.where("doc_id % 2 = 0"), folder, "tier1", "essays", "ocean_O_lr")
    sinks.prediction_file(docs.where("doc_id % 2 = 1"), folder, "tier2a", "mbti", "16class_nb")
    return readers.predictions(spark, f"{folder}/*.jsonl")


@register("word_vector_file", "SELECT 'w' || vec_id AS word, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE vec_id % 2 = 0")
def word_vector_file(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as a text file of words, of which only the words of a vocabulary are kept."""
    path = _folder(spark, "vectors")
    e = table(spark, d, "embeddings")
    word = F.concat(F.lit("w"), F.col("vec_id").cast("string"))
    e.select(F.concat_ws(" ", word, F.transform("embedding", lambda x: x.cast("string"))).alias("value")).write.text(path)
    read = readers.word_vectors(spark, path, e.where("vec_id % 2 = 0").select(word.alias("word")))
    return read.select("word", F.size("vector").cast("bigint").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@register("file_lines", "SELECT count(*) AS n FROM comments")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "lines")
    sinks.sorted_json(table(spark, d, "comments").drop("created_at", "ingested_at")).select("json").write.text(path)
    return spark.range(1).select(F.lit(readers.line_count(spark, path)).cast("bigint").alias("n"))


@register("gold_evidence", f"WITH s AS (SELECT DISTINCT dialogue_id, speaker FROM ({_SAID})) SELECT 'personality_evd_' || substr(md5(dialogue_id || '|' || speaker), 1, 8) AS id, count(*) AS n, count(level_raw) AS n_levels FROM s JOIN dialogue_evidence USING (dialogue_id, speaker) GROUP BY dialogue_id, speaker")
def gold_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of each record that has any, as a file of its own."""
    path = _folder(spark, "gold")
    items = table(spark, d, "dialogue_evidence").groupBy("dialogue_id", "speaker").agg(F.collect_list(F.struct("trait", "level_raw", "utt_ids")).alias("evidence"))  # a few for each speaker of a dialogue
    sinks.gold_evidence(corpora.speaker_records(table(spark, d, "dialogue_turns")).join(items, ["dialogue_id", "speaker"], "left")).write.json(path)
    back = readers.json_lines(spark, path, "id string, evidence array<struct<trait:string,level_raw:string,utt_ids:array<int>>>")
    return back.select("id", F.size("evidence").cast("bigint").alias("n"), F.size(F.filter("evidence", lambda e: e["level_raw"].isNotNull())).cast("bigint").alias("n_levels"))


@register("chunk_file", "SELECT chunk_id, text, coalesce(nullif(facet, ''), text) AS embed_text FROM kb_chunks")
def chunk_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "chunks")
    sinks.chunk_rows(table(spark, d, "kb_chunks").select("chunk_id", "text", F.col("facet").alias("embed_text"))).write.json(path)
    return readers.json_lines(spark, path, readers.CHUNK).select("chunk_id", "text", "embed_text")


@register("resumed_append", "SELECT doc_id, count(*) AS copies FROM documents GROUP BY doc_id")
def resumed_append(spark: SparkSession, d: str) -> DataFrame:
    """A run that wrote only longer texts is taken up again: every record is there once."""
    path = _folder(spark, "resumed")
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    docs.where("n_chars > 450").write.json(path)
    sinks.append_missing(docs, spark.read.schema("doc_id bigint").json(path), "doc_id", path)
    return spark.read.schema("doc_id bigint").json(path).groupBy("doc_id").agg(F.count("*").alias("copies"))


@register("sorted_json", """SELECT '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders""")
def sorted_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sorted_json(table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority", "o_custkey"))


@register("metric_log", "SELECT 'run1' AS run, unnest(['data/mean_chars', 'data/n', 'data/n_labelled']) AS key, 3::INTEGER AS step, unnest([round(avg(n_chars), 6), count(*)::DOUBLE, count(label_mbti)::DOUBLE]) AS value FROM documents")
def metric_log(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a run, appended to a log under their prefix."""
    path = _folder(spark, "metrics")
    whole = table(spark, d, "documents").agg(F.count("*").alias("n"), F.count("label_mbti").alias("n_labelled"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    sinks.metric_rows(whole, "run1", "data", 3).write.mode("append").json(path)
    return spark.read.schema("run string, key string, step int, value double").json(path)


@register("repeated_comments", "SELECT comment_id, count(*) AS n FROM comments GROUP BY comment_id HAVING count(*) > 1")
def repeated_comments(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.repeated_ids(table(spark, d, "comments"), "comment_id")


@register("text_integers", "SELECT doc_id, len(x) AS n, list_max(list_transform(x, lambda v: TRY_CAST(v AS BIGINT))) AS most FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS x FROM documents WHERE text IS NOT NULL)")
def text_integers(spark: SparkSession, d: str) -> DataFrame:
    """Integers of each text; one of more digits than a number holds is null."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.integers("text").alias("x"))
    return docs.select("doc_id", F.size("x").cast("bigint").alias("n"), F.array_max("x").alias("most"))


@register("inferred_traits", f"SELECT chunk_id, CASE WHEN upper(trait) IN ('O', 'C', 'E', 'A', 'N') THEN upper(trait) ELSE list_filter(list_transform({sql_words('text')}, lambda w: upper(w[1])), lambda c: c IN ('O', 'C', 'E', 'A', 'N'))[1] END AS trait FROM kb_chunks")
def inferred_traits(spark: SparkSession, d: str) -> DataFrame:
    """The trait of each chunk, else that of its first word whose first letter names one."""
    return table(spark, d, "kb_chunks").select("chunk_id", L.inferred_trait("trait", X.words("text")).alias("trait"))


@register(
    "quotes_in_text",
    f"""{_QUOTES}, r AS (SELECT dialogue_id, speaker, string_agg(said, ' ' ORDER BY utt_id, said) AS text FROM said GROUP BY ALL), w AS (SELECT dialogue_id, speaker, trait, coalesce(own, anyone) AS quote FROM e LEFT JOIN q USING (k))
        SELECT trait, count(*) AS items, count_if(quote <> '') AS n_quotes, count_if(quote <> '' AND contains(text, quote)) AS in_text FROM w LEFT JOIN r USING (dialogue_id, speaker) GROUP BY trait""",
)
def quotes_in_text(spark: SparkSession, d: str) -> DataFrame:
    """How many quotes of evidence stand as they are in their speaker's record."""
    turns = table(spark, d, "dialogue_turns")
    return corpora.quotes_in_text(corpora.evidence_quotes(table(spark, d, "dialogue_evidence"), turns), corpora.speaker_records(turns))


_LETTERS = ", ".join(f"CASE WHEN substr(t, {k}, 1) IN ('{a}', '{b}') THEN substr(t, {k}, 1) ELSE '{'INTP'[k - 1]}' END" for k, (a, b) in enumerate(("IE", "SN", "TF", "JP"), 1))


@register("assembled_types", f"SELECT doc_id, concat({_LETTERS}) AS predicted FROM (SELECT doc_id, CASE WHEN length({sql_strip('label_mbti')}) = 4 THEN upper({sql_strip('label_mbti')}) END AS t FROM documents)")
def assembled_types(spark: SparkSession, d: str) -> DataFrame:
    """A type from the letters of its axes; an axis without a letter has that of INTP."""
    return table(spark, d, "documents").select("doc_id", L.assembled_type(L.mbti_axes("label_mbti")).alias("predicted"))


@register("prior_labels", "SELECT author, " + " || ',' || ".join(f"'{t}:' || CASE WHEN {c} > 50 THEN 'HIGH' WHEN {c} <= 50 THEN 'LOW' END" for t, c in L.TRAIT_NAMES.items()) + " AS prior FROM author_profiles")
def prior_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label that all five scores give; null where one is missing."""
    return table(spark, d, "author_profiles").select("author", L.prior_label({t: L.percent_level(c) for t, c in L.TRAIT_NAMES.items()}).alias("prior"))


_OWN = rf"list_transform(regexp_extract_all(text, '(?i)\b({TYPES})(s|es)?\b', 1), lambda x: upper(x))"


@register("leakage_examples", f"SELECT kind, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM (SELECT doc_id, unnest(CASE WHEN list_contains({_OWN}, upper(label_mbti)) THEN ['any_type', 'own_type'] ELSE ['any_type'] END) AS kind FROM documents WHERE len({_OWN}) > 0)) WHERE r <= 5")
def leakage_examples(spark: SparkSession, d: str) -> DataFrame:
    """Five texts that mention a type, and five that mention their own."""
    from loomtext.operators import tasks

    own = F.transform(F.regexp_extract_all("text", F.lit(X.TYPE_MENTION), F.lit(1)), F.upper)
    flags = {"any_type": F.size(own) > 0, "own_type": F.array_contains(own, F.upper("label_mbti"))}
    return tasks.flagged(table(spark, d, "documents"), flags, "doc_id", 5).withColumnRenamed("flag", "kind")
