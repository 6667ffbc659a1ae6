"""Queries of the knowledge base, replies, chain, models, augmentation, streams and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import replies
from loomtext.operators import augment, chain, knowledge, metrics, models, profile
from loomtext.plans.analysis_queries import WORDS
from loomtext.plans.catalogue import register
from loomtext.plans.text_queries import sql_strip, sql_tokens, sql_words
from loomtext.session import scratch_dir, table, written
from loomtext.sources import readers, sinks
from loomtext.streaming import running

_POLE = f"CASE WHEN p IN ('HIGH', 'H', '+', 'POSITIVE') THEN 'HIGH' WHEN p IN ('LOW', 'L', '-', 'NEGATIVE') THEN 'LOW' WHEN p IN ('BOTH', 'DEFINITION', 'NEUTRAL', 'MIXED') THEN 'BOTH' ELSE p END"
_REG = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in knowledge.REGISTRY)
_NORMAL = f"""(SELECT chunk_id, text, facet, coalesce(nullif(k.source_id, ''), 'project_seed') AS source_id, lower(coalesce(nullif(framework, ''), 'both')) AS framework, coalesce(nullif(category, ''), 'behavioral_marker') AS category,
    coalesce(nullif(lang, ''), 'en') AS lang, CASE WHEN upper(trait) IN ('O', 'C', 'E', 'A', 'N') THEN upper(trait) ELSE trait END AS trait, {_POLE} AS pole, coalesce(r.tier, 'C') AS tier, coalesce(r.license, 'project_seed') AS license
    FROM (SELECT *, upper({sql_strip("pole")}) AS p FROM kb_chunks) k LEFT JOIN (VALUES {_REG}) r(source_id, tier, license) ON coalesce(nullif(k.source_id, ''), 'project_seed') = r.source_id)"""


def normal_chunks(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.normalized(table(spark, d, "kb_chunks"))


@register("kb_normalized", f"SELECT chunk_id, source_id, framework, category, lang, trait, pole, tier, license FROM {_NORMAL}")
def kb_normalized(spark: SparkSession, d: str) -> DataFrame:
    return normal_chunks(spark, d).select("chunk_id", "source_id", "framework", "category", "lang", "trait", "pole", "tier", "license")


_CATS = str(L.CATEGORIES)


@register(
    "kb_validation",
    f"""SELECT chunk_id, array_to_string(list_filter([CASE WHEN coalesce(chunk_id, '') = '' THEN 'missing chunk_id' END, CASE WHEN coalesce({sql_strip("text")}, '') = '' THEN 'missing text' END, CASE WHEN coalesce(framework, '') = '' THEN 'missing metadata.framework' END,
        CASE WHEN coalesce(category, '') = '' THEN 'missing metadata.category' END, CASE WHEN coalesce(source_id, '') = '' THEN 'missing metadata.source_id' END, CASE WHEN coalesce(trait, '') = '' THEN 'missing metadata.quality_tier' END, CASE WHEN coalesce(lang, '') = '' THEN 'missing metadata.language' END,
        CASE WHEN category IS NULL OR category NOT IN {_CATS} THEN 'invalid category: ' || coalesce(category, 'None') END,
        CASE WHEN trait IS NULL OR trait NOT IN ('A', 'B', 'C') THEN 'invalid quality_tier: ' || coalesce(trait, 'None') END,
        CASE WHEN framework = 'ocean' AND coalesce(category, '') NOT IN ('evidence_mapping_example', 'few_shot_example') AND (trait IS NULL OR trait NOT IN ('O', 'C', 'E', 'A', 'N')) THEN 'ocean chunk missing valid trait' END,
        CASE WHEN coalesce(pole, '') <> '' AND pole NOT IN ('HIGH', 'LOW', 'BOTH') THEN 'invalid pole: ' || pole END], lambda e: e IS NOT NULL), '; ') AS errors FROM kb_chunks""",
)
def kb_validation(spark: SparkSession, d: str) -> DataFrame:
    """The table has no tier: the trait's letter, which is one of A to C or none of them, stands for it."""
    c = {k: F.col(k) for k in ("chunk_id", "text", "framework", "category", "source_id", "lang", "trait", "pole")} | {"tier": F.col("trait")}
    return table(spark, d, "kb_chunks").select("chunk_id", F.array_join(L.validation_errors(c), "; ").alias("errors"))


@register(
    "kb_embed_text",
    f"""SELECT chunk_id, {sql_strip("lead || ' ' || " + sql_strip("text"))} AS embed_text FROM (SELECT *, CASE category WHEN 'state_definition' THEN 'State: UnlabeledState. Trait signals: ' || s || '. Definition:'
        WHEN 'behavioral_marker' THEN 'Behavioral marker. Framework: ' || f || '. Trait: ' || s || '.' WHEN 'linguistic_correlate' THEN 'Linguistic correlate. Framework: ' || f || '. Trait: ' || s || '.'
        WHEN 'trait_definition' THEN 'Trait definition. Framework: ' || f || '. Trait: ' || t || '.' WHEN 'facet_definition' THEN 'Facet definition. Trait: ' || t || '. Facet: ' || coalesce(facet, 'unspecified') || '. Pole: ' || coalesce(pole, 'BOTH') || '.'
        WHEN 'type_description' THEN 'Type description. Framework: ' || f || '. Type: unspecified.' WHEN 'cognitive_function' THEN 'Cognitive function. Type: unspecified. Function: unspecified.'
        WHEN 'evidence_mapping_example' THEN 'Evidence mapping. Framework: ' || f || '. Trait: ' || t || ' ' || coalesce(pole, 'BOTH') || '. Source: ' || source_id || '.' WHEN 'few_shot_example' THEN 'Few-shot example. Framework: ' || f || '. Target: unspecified. Example: unspecified.'
        ELSE 'Knowledge chunk. Framework: ' || f || '. Category: ' || category || '.' END AS lead FROM (SELECT *, upper(framework) AS f, coalesce(trait, 'unspecified') AS t, coalesce(trait || CASE pole WHEN 'HIGH' THEN '+' WHEN 'LOW' THEN '-' ELSE '' END, 'unspecified') AS s FROM {_NORMAL}))""",
)
def kb_embed_text(spark: SparkSession, d: str) -> DataFrame:
    chunks = normal_chunks(spark, d)
    return chunks.select("chunk_id", knowledge.embed_text({k: F.col(k) for k in ("text", "category", "framework", "trait", "pole", "facet", "source_id")}).alias("embed_text"))


_FIELDS = ("framework", "category", "tier", "trait", "pole", "source_id")


@register("kb_summary", " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}, '<missing>') AS value, count(*) AS n FROM {_NORMAL} GROUP BY 2" for c in _FIELDS))
def kb_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.counters(normal_chunks(spark, d), list(_FIELDS))


@register("trait_by_category", f"SELECT category, count_if(trait = 'O') AS \"O\", count_if(trait = 'C') AS \"C\", count_if(trait = 'E') AS \"E\", count_if(trait = 'A') AS \"A\", count_if(trait = 'N') AS \"N\" FROM {_NORMAL} WHERE framework = 'ocean' GROUP BY category")
def trait_by_category(spark: SparkSession, d: str) -> DataFrame:
    ocean = normal_chunks(spark, d).where("framework = 'ocean'")
    return ocean.groupBy("category").pivot("trait", list(L.TRAITS)).count().na.fill(0, list(L.TRAITS))


@register("kb_views", f"SELECT 'full' AS view, count(*) AS n FROM {_NORMAL} UNION ALL SELECT 'ocean', count_if(framework IN ('ocean', 'both')) FROM {_NORMAL} UNION ALL SELECT 'mbti', count_if(framework IN ('mbti', 'both')) FROM {_NORMAL} UNION ALL SELECT 'examples', count_if(category IN ('few_shot_example', 'evidence_mapping_example')) FROM {_NORMAL}")
def kb_views(spark: SparkSession, d: str) -> DataFrame:
    views = sinks.kb_views(written(normal_chunks(spark, d), "chunks"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n") for name, df in views.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("kb_manifest")
def kb_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest(normal_chunks(spark, d))


@register("chunked_documents")
def chunked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at paragraph and post marks, packed to 160 words; checked against a plain loop in the tests."""
    out = knowledge.chunked(table(spark, d, "documents", True).select("doc_id", "text"), 160, 16, 5, "doc_id", "text", r"\n\n+|\|\|\|")
    return out.select(F.col("doc_id").alias("chunk_id"), "text", "subchunk_index")


@register(
    "step_blocks",
    "SELECT dialogue_id, k - 1 AS block, b[k] AS line FROM (SELECT dialogue_id, string_split(string_agg(utterance, chr(10) ORDER BY utt_id, utterance), chr(10)) AS b FROM dialogue_turns WHERE utterance IS NOT NULL GROUP BY 1), LATERAL (SELECT unnest(range(1, len(b) + 1)) AS k)",
)
def step_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a dialogue as numbered blocks."""
    turns = table(spark, d, "dialogue_turns").where("utterance IS NOT NULL")
    listed = turns.groupBy("dialogue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("utt_id", "utterance"))), lambda x: x["utterance"]), "\n").alias("t"))
    out = listed.select("dialogue_id", F.posexplode(F.split("t", "\n")).alias("block", "line"))
    return out.withColumn("block", F.col("block").cast("bigint"))


@register("kb_step_blocks")
def kb_step_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of worked examples in the knowledge base, cut before steps 2 and 3."""
    out = table(spark, d, "kb_chunks").select("chunk_id", F.posexplode(knowledge.step_blocks(F.col("text"))).alias("block", "text"))
    return out.withColumn("block", F.col("block").cast("bigint"))


_HASH = f"list_transform({sql_tokens('text')}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64)"


@register("hashed_vectors", f"SELECT chunk_id, round(list_sum(list_transform(range(0, 64), lambda k: (k + 1) * len(list_filter(h, lambda s: s = k)))) / sqrt(list_sum(list_transform(range(0, 64), lambda k: len(list_filter(h, lambda s: s = k)) ** 2))), 6) AS checksum FROM (SELECT chunk_id, {_HASH} AS h FROM kb_chunks WHERE text IS NOT NULL) WHERE len(h) > 0")
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "kb_chunks").select("chunk_id", knowledge.hashed_vector(F.col("text")).alias("v")).where("v IS NOT NULL")
    return v.select("chunk_id", F.round(F.aggregate(F.transform("v", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


@register("upsert_latest", "SELECT author, arg_max(openness, k) AS openness FROM (SELECT author, coalesce(openness, -1) AS openness, md5(concat_ws('|', author, coalesce(mbti, ''), coalesce(openness, -1)::INTEGER)) AS k FROM author_profiles WHERE author IS NOT NULL) GROUP BY author")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "author_profiles").where("author IS NOT NULL").select("author", F.coalesce("openness", F.lit(-1.0)).alias("openness"), "mbti")
    key = F.md5(F.concat_ws("|", "author", F.coalesce("mbti", F.lit("")), F.round("openness").cast("int").cast("string")))
    return knowledge.latest(rows.withColumn("k", key), "author", "k").select("author", "openness")


@register("json_props", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(props->>'$.missing') AS missing FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint, missing string").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"), F.count("p.missing").alias("missing"))


_REPLY = "CASE event_id % 4 WHEN 0 THEN 'Sure: [' || props || ', ' || props || '] done' WHEN 1 THEN '```json' || chr(10) || '[' || props || ']' || chr(10) || '```' WHEN 2 THEN 'broken [' || props || ', {\"k\": ' ELSE 'nothing' END"


@register("json_salvage", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS found, CASE event_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END * (props->>'$.k')::BIGINT AS total FROM events")
def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of the events' JSON with prose, fences and cut ends: what can be recovered."""
    replied = table(spark, d, "events", True).select("event_id", F.expr(_REPLY.replace("chr(10)", "char(10)")).alias("reply"))
    items = replies.salvaged(replied, "reply", "struct<k:bigint>", "x")
    return items.select("event_id", F.size("x").cast("bigint").alias("found"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, i: a + F.coalesce(i["k"], F.lit(0))).alias("total"))


@register("chain_predictions")
def chain_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The three steps with the rule client over all documents."""
    docs = table(spark, d, "documents", True).select("doc_id", "text")
    staged = chain.states(chain.read_evidence(chain.rule_evidence(docs, WORDS)))
    return chain.predict(docs, staged)


@register("chain_parse_rate")
def chain_parse_rate(spark: SparkSession, d: str) -> DataFrame:
    p = chain_predictions(spark, d)
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == "UNKNOWN").alias("unknown"), F.round(F.avg("n_evidence"), 6).alias("mean_evidence"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", True).where("label_mbti IS NOT NULL AND length(text) > 20 AND doc_id IS NOT NULL")
    held = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 10 < 3
    return docs.select("doc_id", "text", F.substring("label_mbti", 1, 1).alias("label"), held.alias("held"))


def _evaluated(predicted: DataFrame) -> DataFrame:
    return metrics.summary(metrics.class_report(metrics.confusion(predicted, F.col("label"), F.col("predicted"))))


@register("model_text_lr")
def model_text_lr(spark: SparkSession, d: str) -> DataFrame:
    rows = written(_labelled(spark, d), "rows")
    model = models.fit_text(rows.where("NOT held"), "lr", "label")
    return _evaluated(models.predict_labels(model, rows.where("held")))


@register("model_text_vote")
def model_text_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = written(_labelled(spark, d), "rows")
    fitted = [models.fit_text(rows.where("NOT held"), name, "label") for name in ("lr", "nb")]
    votes = models.soft_vote(fitted, rows.where("held"), "doc_id")
    return _evaluated(votes.join(rows.select("doc_id", "label"), "doc_id"))


@register("model_vectors")
def model_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A small network on the embeddings, judged on a held-out third."""
    v = table(spark, d, "embeddings").withColumn("held", F.col("vec_id") % 3 == 0)
    model, _ = models.fit_vectors(v.where("NOT held"), "embedding", "label", 10)
    from pyspark.ml.functions import array_to_vector

    test = v.where("held").select("label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    done = model.transform(test).select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
    return _evaluated(done)


@register("augmented_texts", "SELECT CASE WHEN a THEN 'copy' ELSE 'original' END AS kind, count(*) AS n FROM (SELECT false AS a FROM documents UNION ALL SELECT true FROM documents, (SELECT unnest([1, 2])) WHERE text IS NOT NULL) GROUP BY kind")
def augmented_texts(spark: SparkSession, d: str) -> DataFrame:
    out = augment.augmented(table(spark, d, "documents"), 2)
    return out.groupBy(F.when(F.col("augmented"), "copy").otherwise("original").alias("kind")).agg(F.count("*").alias("n"))


@register("augmented_train")
def augmented_train(spark: SparkSession, d: str) -> DataFrame:
    """All documents and two changed copies of those of the train split: (doc_id, text, augmented)."""
    return augment.augmented(table(spark, d, "documents", True), 2, chosen=F.lower(F.trim("split")).isin("train", "training"))


def _streamed(spark: SparkSession, stream: DataFrame, mode: str, name: str, keep: str) -> DataFrame:
    """What a stream has said in the end: of each key the row of the last batch, from a table in the shared folder."""
    base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    running.run_to_end(stream, mode, base + "/state", lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(base + "/out"))
    rows = spark.read.parquet(base + "/out")
    keys = keep.split(",")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema.simpleString()[len("struct<") : -1]
    return running.event_stream(spark, f"{d}/events.parquet*", ", ".join(schema.split(",")).replace(":", " "))


@register("stream_running", "SELECT event_type, count(*) AS n, count_if(event_type = 'error') AS errors, round(sum(value), 4) AS total, max(value) AS slowest FROM events GROUP BY event_type")
def stream_running(spark: SparkSession, d: str) -> DataFrame:
    out = _streamed(spark, running.running_counts(_event_stream(spark, d)), "update", "running", "event_type")
    return out.withColumn("total", F.round("total", 4))


@register("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of all rows, whatever files they come in: no watermark, so the state is one row for each hour and type."""
    out = _streamed(spark, running.windowed_counts(_event_stream(spark, d), late=None), "update", "windows", "start,event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@register("json_round_trip", "SELECT source, count(*) AS n, count(text) AS texts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON Lines by split and read again with their schema."""
    path = f"{scratch_dir(spark)}/records-{uuid.uuid4().hex[:12]}"
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.coalesce("split", F.lit("none")).alias("split"))
    sinks.split_records(docs, path)
    back = readers.json_lines(spark, path, readers.RECORD)
    return back.groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"))


@register("csv_round_trip", "SELECT count(*) AS n, count(nullif(text, '')) AS texts, count_if(lower(copn) = 'y') AS open FROM essays")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/essays-{uuid.uuid4().hex[:12]}"
    table(spark, d, "essays").write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    back = readers.delimited(spark, path, "authid string, text string, copn string, ccon string, cext string, cagr string, cneu string")
    return back.agg(F.count("*").alias("n"), F.count(F.nullif("text", F.lit(""))).alias("texts"), F.count_if(F.lower("copn") == "y").alias("open"))


@register("evaluation_form", f"SELECT substr(md5(doc_id::VARCHAR), 1, 8) AS blind_id, substr(text, 1, 500) AS snippet, coalesce(({sql_words('text')})[1], '') AS evidence_1, coalesce(({sql_words('text')})[2], '') AS evidence_2, coalesce(({sql_words('text')})[3], '') AS evidence_3, label_mbti AS predicted FROM documents")
def evaluation_form(spark: SparkSession, d: str) -> DataFrame:
    from loomtext.functions import text as X

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", X.words("text").alias("evidence"), F.col("label_mbti").alias("predicted"))
    return sinks.evaluation_form(docs)


