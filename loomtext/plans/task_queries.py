"""Queries of task rows, label joins, filtered and fused search, worked examples and per-trait metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import replies
from loomtext.functions import text as X
from loomtext.operators import corpora, evidence, knowledge, metrics, profile, retrieval, tasks
from loomtext.plans.analysis_queries import _LIST, _POST, _SCORED, WORDS, _asked, predictions
from loomtext.plans.catalogue import register
from loomtext.plans.corpus_queries import _LEVEL, _SAID
from loomtext.plans.knowledge_queries import _HASH
from loomtext.plans.text_queries import TYPES, sql_strip, sql_tokens, sql_words
from loomtext.session import table, written

_TYPE = f"CASE WHEN regexp_full_match(upper({sql_strip('label_mbti')}), '{TYPES}') THEN upper({sql_strip('label_mbti')}) END"
_TYPE_ROWS = f"""SELECT doc_id, unnest(['16class', 'IE', 'SN', 'TF', 'JP']) AS task, unnest([y, y[1], y[2], y[3], y[4]]) AS label FROM (SELECT doc_id, {_TYPE} AS y FROM documents WHERE {sql_strip('text')} <> '') WHERE y IS NOT NULL"""


@register("type_tasks", _TYPE_ROWS)
def type_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.type_rows(table(spark, d, "documents"), "doc_id", "text", "label_mbti")


@register("task_selection", f"SELECT * FROM ({_TYPE_ROWS}) WHERE task IN ('IE', 'SN', 'TF', 'JP')")
def task_selection(spark: SparkSession, d: str) -> DataFrame:
    return tasks.task_data(type_tasks(spark, d), "mbti_augmented", "4dim")


_FLAGS = {"O": "copn", "C": "ccon", "E": "cext", "A": "cagr", "N": "cneu"}


@register("trait_tasks", "SELECT authid, unnest([" + ", ".join(f"'ocean_{t}'" for t in _FLAGS) + "]) AS task, unnest([" + ", ".join(f"CASE WHEN lower({c}) = 'y' THEN 'HIGH' ELSE 'LOW' END" for c in _FLAGS.values()) + f"]) AS label FROM essays WHERE {sql_strip('text')} <> ''")
def trait_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.trait_rows(table(spark, d, "essays"), "authid", "text", {t: L.yes_no_level(c) for t, c in _FLAGS.items()})


_SPEAKER = f"SELECT dialogue_id, speaker, {', '.join(f'min(CASE WHEN trait = {t!r} THEN {_LEVEL} END) AS {t}' for t in L.TRAITS)} FROM dialogue_evidence GROUP BY dialogue_id, speaker"
_KNOWN = " AND ".join(f"coalesce({t} IN ('HIGH', 'LOW'), false)" for t in L.TRAITS)
_FILLED = ", ".join(f"coalesce({t}, 'UNKNOWN') AS {t}" for t in L.TRAITS)


@register("speaker_labels", f"SELECT dialogue_id, speaker, {_FILLED}, O || '|' || C || '|' || E || '|' || A || '|' || N AS signature, {_KNOWN} AS complete FROM ({_SPEAKER})")
def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    return tasks.speaker_labels(table(spark, d, "dialogue_evidence"))


@register("complete_speakers", f"SELECT dialogue_id, speaker FROM ({_SPEAKER}) WHERE {_KNOWN}")
def complete_speakers(spark: SparkSession, d: str) -> DataFrame:
    return tasks.speaker_labels(table(spark, d, "dialogue_evidence")).where("complete").select("dialogue_id", "speaker")


@register(
    "labelled_speakers",
    f"""WITH s AS (SELECT dialogue_id, speaker, count(*) AS n_utterances FROM ({_SAID}) GROUP BY ALL), n AS (SELECT dialogue_id, speaker, count(*) AS k FROM dialogue_evidence GROUP BY ALL)
        SELECT s.dialogue_id, s.speaker, n_utterances, coalesce(k, 0) AS n_evidence, {_FILLED} FROM s LEFT JOIN ({_SPEAKER}) l USING (dialogue_id, speaker) LEFT JOIN n USING (dialogue_id, speaker)""",
)
def labelled_speakers(spark: SparkSession, d: str) -> DataFrame:
    records = corpora.speaker_records(table(spark, d, "dialogue_turns")).select("dialogue_id", "speaker", "n_utterances")
    return tasks.labelled_speakers(records, table(spark, d, "dialogue_evidence")).select("dialogue_id", "speaker", "n_utterances", "n_evidence", *L.TRAITS)


@register(
    "evidence_disagreement",
    f"""WITH l AS (SELECT dialogue_id, speaker, trait, min({_LEVEL}) AS label FROM dialogue_evidence GROUP BY ALL), e AS (SELECT dialogue_id, speaker, trait, {_LEVEL} AS level FROM dialogue_evidence)
        SELECT trait, count(*) AS n, count_if(level <> label) AS n_disagree, round(count_if(level <> label) / count(*), 6) AS share FROM e JOIN l USING (dialogue_id, speaker, trait) WHERE level <> 'UNKNOWN' GROUP BY trait""",
)
def evidence_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return tasks.disagreement(table(spark, d, "dialogue_evidence"))


@register("evidence_lengths", f"SELECT trait, {_LEVEL} AS level, count(*) AS n, quantile_cont(len({sql_words('nat_lang')}), 0.5) AS median_words, max(len({sql_words('nat_lang')})) AS most_words FROM dialogue_evidence WHERE nat_lang IS NOT NULL GROUP BY ALL")
def evidence_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dialogue_evidence").where("nat_lang IS NOT NULL").select("trait", L.level("level_raw").alias("level"), X.word_count("nat_lang").alias("w"))
    # numbers of words are few, so the percentile holds few distinct values
    return rows.groupBy("trait", "level").agg(F.count("*").alias("n"), F.percentile("w", F.lit(0.5)).alias("median_words"), F.max("w").cast("bigint").alias("most_words"))


@register(
    "dataset_profiles",
    f"""SELECT source, count(*) AS n, count_if({sql_strip('text')} <> '') AS n_texts, count(label_mbti) AS n_labelled, count(split) AS n_split, round(avg(length(text)), 6) AS mean_chars, max(len({sql_words('text')})) AS most_words,
        count(*) - count(DISTINCT md5(coalesce(text, ''))) AS repeated, round(avg(CASE WHEN lower(lang) = 'en' THEN 1.0 ELSE 0.0 END), 6) AS english FROM documents GROUP BY source""",
)
def dataset_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profile.combined(table(spark, d, "documents"), "source")


@register("split_suffixes", "WITH s AS (SELECT DISTINCT source || CASE WHEN split IS NULL THEN '' ELSE '_' || split END AS stem FROM documents WHERE source IS NOT NULL) SELECT stem, CASE WHEN regexp_matches(stem, '_(train|eval|test)$') THEN regexp_extract(stem, '^(.*)_(train|eval|test)$', 1) ELSE stem END AS base, CASE WHEN regexp_matches(stem, '_(train|eval|test)$') THEN regexp_extract(stem, '_(train|eval|test)$', 1) ELSE 'test' END AS split FROM s")
def split_suffixes(spark: SparkSession, d: str) -> DataFrame:
    stems = table(spark, d, "documents").where("source IS NOT NULL").select(F.concat_ws("_", "source", "split").alias("stem")).distinct()
    return stems.withColumn("s", tasks.split_suffix("stem")).select("stem", "s.base", "s.split")


def _flags() -> dict[str, Column]:
    n = X.word_count("text")
    return {"short": n < 12, "long": n > 450, "very_long": n > 1700, "names_type": F.col("text").rlike(rf"(?i)\b({TYPES})\b"), "no_label": F.col("label_mbti").isNull(), "no_text": F.col("text").isNull()}


_N = f"len({sql_words('text')})"


@register(
    "flagged_samples",
    f"""SELECT flag, doc_id FROM (SELECT flag, doc_id, row_number() OVER (PARTITION BY flag ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM (SELECT doc_id, unnest(list_filter([CASE WHEN {_N} < 12 THEN 'short' END, CASE WHEN {_N} > 450 THEN 'long' END, CASE WHEN {_N} > 1700 THEN 'very_long' END,
        CASE WHEN regexp_matches(text, '(?i)\\b({TYPES})\\b') THEN 'names_type' END, CASE WHEN label_mbti IS NULL THEN 'no_label' END, CASE WHEN text IS NULL THEN 'no_text' END], lambda x: x IS NOT NULL)) AS flag FROM documents)) WHERE r <= 3""",
)
def flagged_samples(spark: SparkSession, d: str) -> DataFrame:
    return tasks.flagged(table(spark, d, "documents"), _flags(), "doc_id", 3)


@register("bagged_samples", "SELECT bag::INTEGER AS bag, split, count(*) AS n, sum(doc_id)::BIGINT AS checksum FROM documents, (SELECT unnest(range(0, 10)) AS bag) WHERE ('0x' || substr(md5(bag || '|' || doc_id), 1, 8))::BIGINT < 3435973836 GROUP BY ALL")
def bagged_samples(spark: SparkSession, d: str) -> DataFrame:
    return tasks.bags(table(spark, d, "documents"), "doc_id").groupBy("bag", "split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("checksum"))


_HELD = "substr(md5(dialogue_id), 1, 1) >= 'd'"


@register(
    "mapping_chunks",
    f"""WITH r AS (SELECT dialogue_id, speaker, trait, {_LEVEL} AS level, {sql_strip('nat_lang')} AS quote, {_HELD} AS held FROM dialogue_evidence WHERE trait IS NOT NULL AND nat_lang IS NOT NULL),
        s AS (SELECT DISTINCT dialogue_id, speaker, trait, level, quote FROM r WHERE NOT held AND quote NOT IN (SELECT quote FROM r WHERE held)),
        k AS (SELECT *, md5(concat_ws('|', dialogue_id, coalesce(speaker, ''), trait, level, quote)) AS key, CASE trait {' '.join(f"WHEN '{t}' THEN '{n}'" for t, n in L.TRAIT_NAMES.items())} END AS name FROM s)
        SELECT 'mapping_' || substr(key, 1, 12) AS chunk_id, CASE WHEN level = 'UNKNOWN' THEN 'The statement "' || quote || '" does not settle ' || name || '; abstain.' ELSE 'The statement "' || quote || '" is evidence of ' || level || ' ' || name || '.' END AS text, trait,
        CASE WHEN level = 'UNKNOWN' THEN 'BOTH' ELSE level END AS pole, CASE WHEN level = 'UNKNOWN' THEN 'insufficient_evidence' ELSE 'evidence_mapping' END AS mapping FROM (SELECT *, row_number() OVER (PARTITION BY trait, level ORDER BY key) AS rank FROM k) WHERE rank <= 20""",
)
def mapping_chunks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.mapping_chunks(table(spark, d, "dialogue_evidence"), F.expr(_HELD), 20)


@register("eligible_sentences", f"SELECT doc_id, sentence_idx, CASE WHEN len({sql_words('sentence')}) < 4 THEN 0.0::DOUBLE ELSE round(least(1.0, 10.0 * len(list_intersect(list_distinct({sql_tokens('sentence')}), {_LIST})) / greatest(len(list_distinct({sql_tokens('sentence')})), 1))::DOUBLE, 6) END AS score, len({sql_words('sentence')}) >= 4 AS eligible FROM ({_SCORED})")
def eligible_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of at least four words; shorter ones stay, with score 0."""
    return evidence.with_eligibility(evidence.scored_sentences(table(spark, d, "documents"), WORDS)).select("doc_id", "sentence_idx", F.round("score", 6).alias("score"), "eligible")


# search over the chunks of the knowledge base: queries are all documents whose id is divisible by 50
_ADMIT = f"framework IN ('ocean', 'both') AND category IN {retrieval.STATE_CATEGORIES}"
_ADMIT_TRAIT = f"framework IN ('ocean', 'both') AND category IN {retrieval.TRAIT_CATEGORIES}"
_VEC = "list_transform(range(0, 64), lambda k: len(list_filter(h, lambda s: s = k))::DOUBLE)"


def _ranked(scores: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({scores})) WHERE rank <= {k})"


def _keyword_sql(admit: str, k: int) -> str:
    return _ranked(f"SELECT query_id, chunk_id, round(score, 9) AS score FROM s WHERE chunk_id IN (SELECT chunk_id FROM kb_chunks WHERE {admit})", k)


def _vector_sql(admit: str, k: int) -> str:
    v = f"(SELECT chunk_id, {_VEC} AS v FROM (SELECT chunk_id, {_HASH} AS h FROM kb_chunks WHERE {admit}) WHERE len(h) > 0)"
    q = f"(SELECT query_id, {_VEC} AS q FROM (SELECT doc_id AS query_id, {_HASH} AS h FROM documents WHERE doc_id % 50 = 0) WHERE len(h) > 0)"
    return _ranked(f"SELECT query_id, chunk_id, round(list_cosine_similarity(q, v), 9) AS score FROM {q}, {v}", k)


def _fused_sql(admit: str, k: int) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ra NULLS LAST, rb NULLS LAST, chunk_id) AS rank FROM (SELECT query_id, chunk_id, coalesce(0.7::DOUBLE / (60 + a.rank), 0) + coalesce(0.3::DOUBLE / (60 + b.rank), 0) AS score, a.rank AS ra, b.rank AS rb
        FROM {_vector_sql(admit, 2 * k)} a FULL JOIN {_keyword_sql(admit, 2 * k)} b USING (query_id, chunk_id))) WHERE rank <= {k})"""


def _hits(spark: SparkSession, d: str, how: str, k: int, categories: tuple[str, ...] = retrieval.STATE_CATEGORIES) -> DataFrame:
    return retrieval.search(table(spark, d, "kb_chunks"), _asked(spark, d), how, k, "ocean", categories)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("kb_keyword_filtered", f"WITH {_POST} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {_keyword_sql(_ADMIT, 10)}")
def kb_keyword_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_hits(spark, d, "keyword", 10))


@register("kb_semantic_filtered", f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {_vector_sql(_ADMIT, 10)}")
def kb_semantic_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_hits(spark, d, "semantic", 10))


@register("kb_hybrid", f"WITH {_POST} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {_fused_sql(_ADMIT, 10)}")
def kb_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_hits(spark, d, "hybrid", 10))


# what a query expects, from the chunk that its id names
_GOLD = "(SELECT q.doc_id AS query_id, trait AS expected_trait, category AS expected_category, CASE WHEN pole IN ('HIGH', 'LOW') THEN pole END AS expected_pole FROM documents q JOIN (SELECT *, regexp_extract(chunk_id, '[0-9]+$')::BIGINT AS k FROM kb_chunks) c ON c.k = q.doc_id // 50 % 240 WHERE q.doc_id % 50 = 0)"
_MET = "(expected_trait IS NULL OR coalesce(trait = expected_trait, false)) AND (expected_category IS NULL OR coalesce(category = expected_category, false)) AND (expected_pole IS NULL OR coalesce(pole = expected_pole, false) OR coalesce(pole = 'BOTH', false))"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.expr("doc_id div 50 % 240").alias("k"))
    chunks = table(spark, d, "kb_chunks")  # each chunk's number
    placed = chunks.select("chunk_id", "trait", "category", "pole", F.expr("cast(regexp_extract(chunk_id, '[0-9]+$', 0) as bigint)").alias("k"))
    pole = F.when(F.col("pole").isin("HIGH", "LOW"), F.col("pole"))
    return ids.join(placed, "k").select("query_id", F.col("trait").alias("expected_trait"), F.col("category").alias("expected_category"), pole.alias("expected_pole"))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    gold = _gold(spark, d)
    hits = retrieval.search(table(spark, d, "kb_chunks"), _asked(spark, d), "keyword", 10)
    return hits.join(table(spark, d, "kb_chunks").select("chunk_id", "trait", "category", "pole"), "chunk_id").join(gold, "query_id"), gold


@register(
    "retrieval_eval",
    f"""WITH {_POST}, gold AS {_GOLD}, h AS (SELECT query_id, min(rank) AS first FROM {_keyword_sql("true", 10)} JOIN kb_chunks USING (chunk_id) JOIN gold USING (query_id) WHERE {_MET} GROUP BY 1)
        SELECT expected_trait, count(*) AS n, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1 / first, 0.0)), 6) AS mrr FROM gold LEFT JOIN h USING (query_id) GROUP BY 1""",
)
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    hits, gold = _judged(spark, d)
    return retrieval.evaluate(hits, gold, retrieval.gold_match(), "expected_trait")


@register(
    "retrieval_misses",
    f"""WITH {_POST}, gold AS {_GOLD}, r AS (SELECT * FROM {_keyword_sql("true", 10)}), h AS (SELECT DISTINCT query_id FROM r JOIN kb_chunks USING (chunk_id) JOIN gold USING (query_id) WHERE {_MET})
        SELECT gold.query_id, string_agg(chunk_id, ' ' ORDER BY rank) AS top FROM gold LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r ON r.query_id = gold.query_id WHERE gold.query_id NOT IN (SELECT query_id FROM h) GROUP BY 1""",
)
def retrieval_misses(spark: SparkSession, d: str) -> DataFrame:
    hits, gold = _judged(spark, d)
    hits = written(hits, "hits")
    return retrieval.misses(hits, gold, retrieval.gold_match()).select("query_id", F.array_join("top", " ").alias("top"))


@register(
    "kb_used",
    f"""WITH {_POST}, b AS (SELECT query_id, chunk_id, min((stage, rank)) AS seat FROM (SELECT query_id, chunk_id, 0 AS stage, rank FROM {_keyword_sql(_ADMIT, 12)} UNION ALL SELECT query_id, chunk_id, 1, rank FROM {_keyword_sql(_ADMIT_TRAIT, 12)}) GROUP BY 1, 2)
        SELECT query_id, place, chunk_id, substr(text, 1, 200) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seat, chunk_id) AS place FROM b) JOIN kb_chunks USING (chunk_id) WHERE place <= 20""",
)
def kb_used(spark: SparkSession, d: str) -> DataFrame:
    states, traits = _hits(spark, d, "keyword", 12), _hits(spark, d, "keyword", 12, retrieval.TRAIT_CATEGORIES)
    return retrieval.used_chunks(states, traits, table(spark, d, "kb_chunks"))


@register("index_statistics", f"SELECT framework, category, count(*) AS n_chunks, count_if(len(h) > 0) AS n_vectors FROM (SELECT framework, category, {_HASH} AS h FROM kb_chunks) GROUP BY ALL")
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "kb_chunks").select("framework", "category", knowledge.hashed_vector(F.col("text")).isNotNull().alias("has"))
    return c.groupBy("framework", "category").agg(F.count("*").alias("n_chunks"), F.count_if("has").alias("n_vectors"))


# metrics of several traits in one string: gold from the scores, the prediction from the next trait's score
_NEXT = dict(zip(L.TRAITS, L.TRAITS[1:] + L.TRAITS[:1], strict=True))
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in L.TRAIT_NAMES.values())


def _trait_strings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "author_profiles").where(_WHOLE)
    own = {t: L.percent_level(c) for t, c in L.TRAIT_NAMES.items()}
    return p.select("author", L.trait_string(own).alias("gold"), L.trait_string({t: own[n] for t, n in _NEXT.items()}).alias("predicted"))


_PAIRS = f"(SELECT unnest({list(L.TRAITS)}) AS trait, unnest([{', '.join(f'{L.TRAIT_NAMES[t]} > 50' for t in L.TRAITS)}]) AS y, unnest([{', '.join(f'{L.TRAIT_NAMES[_NEXT[t]]} > 50' for t in L.TRAITS)}]) AS p FROM author_profiles WHERE {_WHOLE})"


@register("trait_metrics", f"SELECT trait, count(*) AS n, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round((CASE WHEN count_if(y OR p) = 0 THEN NULL ELSE 2 * count_if(y AND p) / (count_if(y) + count_if(p)) END * (CASE WHEN count_if(y OR p) > 0 THEN 1 ELSE 0 END) + CASE WHEN count_if(NOT y OR NOT p) = 0 THEN NULL ELSE 2 * count_if(NOT y AND NOT p) / (count_if(NOT y) + count_if(NOT p)) END) / 2, 6) AS macro_f1 FROM {_PAIRS} GROUP BY trait")
def trait_metrics(spark: SparkSession, d: str) -> DataFrame:
    report = metrics.trait_report(_trait_strings(spark, d), "gold", "predicted")
    return metrics.summary(report, ["trait"]).select("trait", "n", "accuracy", "macro_f1")


@register("micro_metrics", "SELECT source, round(avg(CASE WHEN y = a THEN 1.0 ELSE 0.0 END), 6) AS micro_precision, round(avg(CASE WHEN y = a THEN 1.0 ELSE 0.0 END), 6) AS micro_recall, round(avg(CASE WHEN y = a THEN 1.0 ELSE 0.0 END), 6) AS micro_f1 FROM (SELECT source, substr(label_mbti, 1, 1) AS y, CASE WHEN n_chars > 450 THEN 'I' ELSE 'E' END AS a FROM documents WHERE label_mbti IS NOT NULL AND n_chars IS NOT NULL) GROUP BY source")
def micro_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.micro(metrics.class_report(metrics.confusion(predictions(spark, d), F.col("y"), F.col("a"), ["source"]), ["source"]), ["source"])


_BOTH = "(SELECT source, substr(label_mbti, 1, 1) AS y, unnest(['length', 'id']) AS method, unnest([CASE WHEN n_chars > 450 THEN 'I' ELSE 'E' END, CASE WHEN doc_id % 3 = 0 THEN 'E' ELSE 'I' END]) AS p FROM documents WHERE label_mbti IS NOT NULL AND n_chars IS NOT NULL)"
_F1 = f"(SELECT source, method, avg(f1) AS macro_f1 FROM (SELECT source, method, label, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (s + q) END AS f1 FROM (SELECT source, method, label, count_if(y = label AND p = label) AS tp, count_if(y = label) AS s, count_if(p = label) AS q FROM {_BOTH}, (SELECT unnest(['E', 'I']) AS label) GROUP BY ALL HAVING count_if(y = label OR p = label) > 0)) GROUP BY ALL)"


@register("best_method", f"SELECT source, arg_max(method, (round(macro_f1, 6), method)) AS method, round(max(macro_f1), 6) AS macro_f1 FROM (SELECT * FROM {_F1}) WHERE source IN (SELECT source FROM documents) GROUP BY source")
def best_method(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).where("y IN ('E', 'I')").select("source", "y", F.explode(F.create_map(F.lit("length"), F.col("a"), F.lit("id"), F.col("b"))).alias("method", "p"))
    report = metrics.class_report(metrics.confusion(rows, F.col("y"), F.col("p"), ["source", "method"]), ["source", "method"])
    return metrics.best(metrics.summary(report, ["source", "method"]), "source", "method", "macro_f1")


@register("log_loss", "SELECT source, count(*) AS n, round(avg(-ln(greatest(1e-15, CASE WHEN y = 'I' THEN p ELSE 1 - p END))), 6) AS log_loss FROM (SELECT source, substr(label_mbti, 1, 1) AS y, 1 / (1 + exp(-(n_chars - 450) / 400.0)) AS p FROM documents WHERE label_mbti IS NOT NULL AND n_chars IS NOT NULL) GROUP BY source")
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("label_mbti IS NOT NULL AND n_chars IS NOT NULL")
    p = 1 / (1 + F.exp(-(F.col("n_chars") - 450) / 400.0))
    return metrics.log_loss(docs.select("source", F.when(F.substring("label_mbti", 1, 1) == "I", p).otherwise(1 - p).alias("p")), "p", ["source"])


# nested documents: each text in its JSON, the posts as a list
_STRINGS = f"SELECT DISTINCT s AS string FROM (SELECT unnest(list_concat(string_split(text, '|||'), [author, domain_name])) AS s FROM documents WHERE text IS NOT NULL) WHERE length({sql_strip('s')}) >= 30"


@register("nested_strings", f"SELECT md5(string) AS key, length(string) AS n FROM ({_STRINGS})")
def nested_strings(spark: SparkSession, d: str) -> DataFrame:
    posts = F.split("text", r"\|\|\|")
    nested = table(spark, d, "documents").where("text IS NOT NULL").select(F.to_json(F.struct("doc_id", F.struct(F.struct("author", "domain_name").alias("who"), posts.alias("posts")).alias("record"))).alias("json"))
    found = nested.select(F.explode(replies.strings_of(F.col("json"))).alias("string")).where(F.length(X.strip("string")) >= 30).distinct()
    return found.select(F.md5("string").alias("key"), F.length("string").cast("bigint").alias("n"))


@register("greedy_replies", "SELECT doc_id, lang AS read_lang, n_chars AS read_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 2 = 1")
def greedy_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies with an object among other words, every second one broken off; what can't be read gives nulls."""
    docs = table(spark, d, "documents")
    reply = F.concat(F.lit("Here it is: "), F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("lang", "n_chars"))).otherwise(F.lit('{"lang": "en", ')), F.lit(" Done."))
    got = docs.select("doc_id", replies.first_object(reply, "lang string, n_chars bigint").alias("o"))
    return got.select("doc_id", F.col("o.lang").alias("read_lang"), F.col("o.n_chars").alias("read_chars"))


@register("position_alignment", "WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE doc_id % 2 = 1) SELECT source, place, a.doc_id AS first_id, b.doc_id AS second_id FROM a JOIN b USING (source, place)")
def position_alignment(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id")
    return metrics.by_position(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "source", "doc_id").select("source", F.col("place").cast("bigint").alias("place"), F.col("doc_id").alias("first_id"), F.col("other").alias("second_id"))


@register("atomic_chunks", f"SELECT doc_id, n, CASE WHEN source = 'kb_notes' THEN 320 ELSE 160 END AS most, n <= CASE WHEN source = 'kb_notes' THEN 320 ELSE 160 END AS atomic FROM (SELECT doc_id, source, len({sql_words('text')}) AS n FROM documents WHERE text IS NOT NULL)")
def atomic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Which texts stay one chunk under the settings of their category; notes have those of worked examples."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("category", F.when(F.col("source") == "kb_notes", "evidence_mapping_example").otherwise("behavioral_marker"))
    set_ = knowledge.with_settings(docs)
    return set_.select("doc_id", X.word_count("text").cast("bigint").alias("n"), F.col("setting.atomic_words").alias("most"), (X.word_count("text") <= F.col("setting.atomic_words")).alias("atomic"))


@register("category_chunks")
def category_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of all texts under the settings of their category: whole where short enough, else packed by paragraphs."""
    docs = table(spark, d, "documents", True).where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.when(F.col("source") == "kb_notes", "evidence_mapping_example").otherwise("behavioral_marker").alias("category"))
    return knowledge.chunked_by_category(docs).select("chunk_id", "subchunk_index", "text")
