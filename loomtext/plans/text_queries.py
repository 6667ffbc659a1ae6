"""Queries of the text and label functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import text as X
from loomtext.plans.catalogue import register
from loomtext.session import table

W = X.WHITE
TYPES = "|".join(X.MBTI_TYPES)
#: The cleaning in SQL, without the normal form, which DuckDB lacks.
def sql_clean(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({x}, '{X.URL}', ' ', 'g'), '{X.MENTION}', ' ', 'g'), '|||', ' '),
    '(?i)\b({TYPES})(s|es)?\b', '', 'g'), '([!?.]){{2,}}', '\1', 'g'), '{W}+', ' ', 'g'), ' ')"""


SQL_CLEAN = sql_clean("text")


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{W}+'), lambda w: w <> '')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def sql_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]){W}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


@register("text_clean", rf"SELECT doc_id, {SQL_CLEAN} AS cleaned FROM documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", True).select("doc_id", X.clean("text", normalize=False).alias("cleaned"))


@register("text_normal_form")
def text_normal_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", True).select("doc_id", X.clean("text", lower=True).alias("cleaned"))


def _prepared(spark: SparkSession, d: str, limit: int) -> DataFrame:
    docs = table(spark, d, "documents", True).select("doc_id", X.clean("text", normalize=False).alias("c"))
    n = X.word_count("c")
    return docs.select("doc_id", F.when(F.col("c").isNotNull(), n).alias("n_words"), F.when(F.col("c").isNotNull(), n >= 10).alias("valid"), F.when(n >= 10, X.truncate_words("c", limit)).alias("prepared"))


def _prepared_sql(limit: int) -> str:
    return rf"""SELECT doc_id, n_words, n_words >= 10 AS valid, CASE WHEN n_words >= 10 THEN cut END AS prepared FROM (
        SELECT doc_id, c, len(w)::BIGINT AS n_words, CASE WHEN len(w) > {limit} THEN array_to_string(w[1:{limit}], ' ') ELSE c END AS cut
        FROM (SELECT doc_id, c, {sql_words("c")} AS w FROM (SELECT doc_id, {SQL_CLEAN} AS c FROM documents)))"""


@register("text_prepared", _prepared_sql(200))
def text_prepared(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d, 200)


@register("text_prepared_whole", _prepared_sql(2000))
def text_prepared_whole(spark: SparkSession, d: str) -> DataFrame:
    """text_prepared with the reference's limit of 2,000 words."""
    return _prepared(spark, d, 2000)


@register("sentence_split", rf"SELECT doc_id, (i - 1)::BIGINT AS sentence_idx, s[i] AS sentence FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", True).select("doc_id", F.posexplode(X.sentences("text")).alias("sentence_idx", "sentence"))
    return docs.withColumn("sentence_idx", F.col("sentence_idx").cast("bigint"))


@register("word_tokens", rf"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY token")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents", True).select("doc_id", F.explode(X.tokens("text")).alias("token"))
    per = each.groupBy("token", "doc_id").agg(F.count("*").alias("m"))
    return per.groupBy("token").agg(F.sum("m").alias("n"), F.count("*").alias("n_docs"))


_FORUM = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?m)^>.*$', '', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '#+{W}*', '', 'g'), '^{W}+|{W}+$', '', 'g')"
_BOT = " OR ".join(f"contains(lower(body), '{p}')" for p in X.BOT_PHRASES)


@register("forum_clean", f"SELECT comment_id, ingested_at, {_FORUM} AS cleaned, ({_BOT}) AS bot FROM comments")
def forum_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comments", True).select("comment_id", "ingested_at", X.forum_clean("body").alias("cleaned"), X.is_bot("body").alias("bot"))


@register("excerpts", rf"SELECT doc_id, CASE WHEN length(x) > 80 THEN substr(x, 1, 80) || '…' ELSE x END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '{W}+', ' ', 'g'), ' ') AS x FROM documents)")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.excerpt("text", 80).alias("excerpt"))


@register(
    "match_windows",
    r"""SELECT doc_id, substr(text, greatest(p - 40, 1)::BIGINT, (p - greatest(p - 40, 1) + length(h) + 40)::BIGINT) AS around FROM (
        SELECT doc_id, text, h, strpos(text, h) AS p FROM (SELECT doc_id, text, regexp_extract(text, '[Ff]orum [a-z]+') AS h FROM documents) WHERE h <> '')""",
)
def match_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.match_window("text", "[Ff]orum [a-z]+", 40).alias("around")).where("around IS NOT NULL")


@register("script_share", "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[一-鿿぀-ヿ가-힯]')) / length(text) ELSE 0.0 END, 6) AS share, share > 0.3 AS east_asian FROM documents")
def script_share(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(X.cjk_share("text"), 6).alias("share")).withColumn("east_asian", F.col("share") > 0.3)


_EN = r"^Utterance\s+(\d+)\s+(.+?)\s+said:\s*(.*)$"
_ZH = r"^第(\d+)句(.+?)说[：:](.*)$"


@register(
    "turn_parse",
    rf"""SELECT dialogue_id, utt_id, turn, coalesce(CASE WHEN en THEN regexp_extract(t, '{_EN}', 2) WHEN zh THEN regexp_extract(t, '{_ZH}', 2) END, 'UNKNOWN') AS said_by,
        CASE WHEN en THEN regexp_extract(t, '{_EN}', 3) WHEN zh THEN regexp_extract(t, '{_ZH}', 3) ELSE t END AS said FROM (
        SELECT *, CASE WHEN en THEN regexp_extract(t, '{_EN}', 1) WHEN zh THEN regexp_extract(t, '{_ZH}', 1) END::BIGINT AS turn FROM (
        SELECT dialogue_id, utt_id, t, coalesce(regexp_matches(t, '{_EN}'), false) AS en, coalesce(regexp_matches(t, '{_ZH}'), false) AS zh
        FROM (SELECT dialogue_id, utt_id, regexp_replace(utterance, '^{W}+|{W}+$', '', 'g') AS t FROM dialogue_turns)))""",
)
def turn_parse(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dialogue_turns").select("dialogue_id", "utt_id", X.strip("utterance").alias("t"))
    en, zh = F.coalesce(F.col("t").rlike(_EN), F.lit(False)), F.coalesce(F.col("t").rlike(_ZH), F.lit(False))
    part = lambda k: F.when(en, F.regexp_extract("t", _EN, k)).when(zh, F.regexp_extract("t", _ZH, k))
    return t.select("dialogue_id", "utt_id", part(1).cast("bigint").alias("turn"), F.coalesce(part(2), F.lit("UNKNOWN")).alias("said_by"), F.when(en | zh, part(3)).otherwise(F.col("t")).alias("said"))


@register("int_lists", "SELECT doc_id, len(x)::BIGINT AS n, coalesce(list_sum(list_transform(x, lambda v: v::BIGINT)), 0)::BIGINT AS total FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{1,6}') AS x FROM documents WHERE text IS NOT NULL)")
def int_lists(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    x = F.transform(F.regexp_extract_all("text", F.lit("[0-9]{1,6}"), F.lit(0)), lambda v: v.cast("bigint"))
    return docs.select("doc_id", F.size(x).cast("bigint").alias("n"), F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@register(
    "text_hashes",
    rf"SELECT doc_id, md5(text) AS exact, md5(substr(regexp_replace(regexp_replace(lower(text), '^{W}+|{W}+$', '', 'g'), '{W}+', ' ', 'g'), 1, 200)) AS near, substr(sha256(text), 1, 16) AS content_key FROM documents",
)
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("exact"), X.near_hash("text").alias("near"), X.content_key("text").alias("content_key"))


def _head_tail_sql(length: int) -> str:
    return f"SELECT doc_id, array_to_string(CASE WHEN len(w) > {length} THEN w[1:{length // 2}] || w[-{length // 2}:] ELSE w END, ' ') AS kept FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)"


@register("head_tail", _head_tail_sql(20))
def head_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(X.head_tail(X.words("text"), 20), " ").alias("kept"))


@register("head_tail_whole", _head_tail_sql(512))
def head_tail_whole(spark: SparkSession, d: str) -> DataFrame:
    """head_tail with the reference's 512 tokens."""
    return table(spark, d, "documents").select("doc_id", F.array_join(X.head_tail(X.words("text"), 512), " ").alias("kept"))


def _encoded_sql(size: int, length: int) -> str:
    return f"""WITH t AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {sql_words("lower(text)")} AS x FROM documents))),
        v AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) + 1 AS id FROM (SELECT w, count(*) AS n FROM t GROUP BY w ORDER BY n DESC, w LIMIT {size - 2})),
        e AS (SELECT t.doc_id, array_agg(coalesce(v.id, 1) ORDER BY i) AS ids FROM t LEFT JOIN v USING (w) WHERE i <= {length} GROUP BY t.doc_id)
        SELECT doc_id, array_to_string(list_resize(coalesce(ids, []), {length}, 0), ' ') AS ids FROM (SELECT doc_id FROM documents) LEFT JOIN e USING (doc_id)"""


@register("vocabulary_encoded", _encoded_sql(1000, 16))
def vocabulary_encoded(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d, 1000, 16)


@register("vocabulary_encoded_whole", _encoded_sql(30_000, 512))
def vocabulary_encoded_whole(spark: SparkSession, d: str) -> DataFrame:
    """vocabulary_encoded with the reference's 30,000 words and 512 positions."""
    return _encoded(spark, d, 30_000, 512)


def _encoded(spark: SparkSession, d: str, size: int, length: int) -> DataFrame:
    from loomtext.operators.features import encode_with_vocabulary

    docs = table(spark, d, "documents").select("doc_id", "text")
    return encode_with_vocabulary(docs, size, length).select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@register(
    "fuzzy_containment",
    rf"""WITH q AS (SELECT dialogue_id, nat_lang, list_distinct({sql_tokens("nat_lang")}) AS qt, regexp_replace(nat_lang, '^{W}+|{W}+$', '', 'g') AS qs FROM dialogue_evidence WHERE nat_lang IS NOT NULL),
        t AS (SELECT dialogue_id, string_agg(utterance, ' ' ORDER BY utt_id, utterance) AS text FROM dialogue_turns WHERE utterance IS NOT NULL GROUP BY dialogue_id)
        SELECT dialogue_id, nat_lang, CASE WHEN len(qt) = 0 THEN false ELSE contains(lower(text), lower(qs)) OR len(list_intersect(qt, list_distinct({sql_tokens("text")}))) >= 0.85 * len(qt) END AS found
        FROM q JOIN t USING (dialogue_id)""",
)
def fuzzy_containment(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "dialogue_turns").where("utterance IS NOT NULL")
    # the utterances of one dialogue, tens at most
    text = turns.groupBy("dialogue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("utt_id", "utterance"))), lambda x: x["utterance"]), " ").alias("text"))
    quotes = table(spark, d, "dialogue_evidence").where("nat_lang IS NOT NULL").select("dialogue_id", "nat_lang")
    return quotes.join(text, "dialogue_id").select("dialogue_id", "nat_lang", X.contains_fuzzily("nat_lang", "text").alias("found"))


@register("quote_ratio")
def quote_ratio(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "dialogue_evidence").select("dialogue_id", "nat_lang", F.explode("utt_ids").alias("utt_id"))
    turns = table(spark, d, "dialogue_turns").select("dialogue_id", "utt_id", "utterance")
    return quotes.join(turns, ["dialogue_id", "utt_id"]).select("dialogue_id", "utt_id", "nat_lang", F.round(X.partial_ratio("nat_lang", "utterance"), 6).alias("ratio"))


@register("safe_names", r"SELECT DISTINCT subreddit, regexp_replace(subreddit, '[^A-Za-z0-9_.-]+', '-', 'g') AS safe FROM comments")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comments").select("subreddit", X.safe_name("subreddit").alias("safe")).distinct()


@register("mbti_axes", f"SELECT row_id, CASE WHEN length(u) = 4 THEN substr(u, 1, 1) END AS ie, CASE WHEN length(u) = 4 THEN substr(u, 4, 1) END AS jp, CASE WHEN u IN {X.MBTI_TYPES} THEN u END AS type FROM (SELECT row_id, upper(regexp_replace(mbti_type, '^{W}+|{W}+$', '', 'g')) AS u FROM forum_types)")
def mbti_axes(spark: SparkSession, d: str) -> DataFrame:
    axes = L.mbti_axes("mbti_type")
    return table(spark, d, "forum_types").select("row_id", axes["IE"].alias("ie"), axes["JP"].alias("jp"), L.mbti("mbti_type").alias("type"))


_ESSAY = {"O": "copn", "C": "ccon", "E": "cext", "A": "cagr", "N": "cneu"}


@register("essay_labels", "SELECT authid, concat_ws(',', " + ", ".join(f"'{t}:' || CASE WHEN lower({c}) = 'y' THEN 'HIGH' ELSE 'LOW' END" for t, c in _ESSAY.items()) + ") AS levels FROM essays")
def essay_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "essays").select("authid", L.trait_string({t: L.yes_no_level(c) for t, c in _ESSAY.items()}).alias("levels"))


@register("ocean_levels", "SELECT author, " + ", ".join(f"CASE WHEN {c} > 50 THEN 'HIGH' WHEN {c} IS NOT NULL THEN 'LOW' END AS {t}_level" for t, c in L.TRAIT_NAMES.items()) + ", concat_ws(',', " + ", ".join(f"'{t}:' || CASE WHEN {c} > 50 THEN 'HIGH' WHEN {c} IS NOT NULL THEN 'LOW' END" for t, c in L.TRAIT_NAMES.items()) + ") AS levels, " + " || ".join(f"CASE WHEN {c} > 50 THEN '1' WHEN {c} IS NOT NULL THEN '0' ELSE 'X' END" for c in L.TRAIT_NAMES.values()) + " AS combo FROM author_profiles")
def ocean_levels(spark: SparkSession, d: str) -> DataFrame:
    levels = {t: L.percent_level(c) for t, c in L.TRAIT_NAMES.items()}
    return table(spark, d, "author_profiles").select("author", *(c.alias(f"{t}_level") for t, c in levels.items()), L.trait_string(levels).alias("levels"), F.coalesce(L.combo(levels), F.lit("")).alias("combo"))


@register("evidence_levels", "SELECT dialogue_id, speaker, trait, CASE WHEN lower(level_raw) LIKE '%high%' OR level_raw LIKE '%高%' THEN 'HIGH' WHEN lower(level_raw) LIKE '%low%' OR level_raw LIKE '%低%' THEN 'LOW' ELSE 'UNKNOWN' END AS level FROM dialogue_evidence")
def evidence_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dialogue_evidence").select("dialogue_id", "speaker", "trait", L.level("level_raw").alias("level"))


@register("record_ids", "SELECT row_id, 'mbti_' || substr(md5(posts), 1, 8) AS id FROM forum_types")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "forum_types").select("row_id", L.record_id("mbti", "posts").alias("id"))


@register("margin_confidence", "SELECT vec_id, CASE WHEN embedding[1] > 0 THEN 'HIGH' ELSE 'LOW' END AS label, round(1 / (1 + exp(-abs(embedding[1]::DOUBLE))), 6) AS confidence FROM embeddings")
def margin_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("embedding")[0].cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.when(m > 0, "HIGH").otherwise("LOW").alias("label"), F.round(L.margin_confidence(m), 6).alias("confidence"))


@register(
    "trait_strings",
    "SELECT trait, level, count(*) AS n FROM (SELECT unnest(['O', 'C', 'E', 'A', 'N']) AS trait, unnest([" + ", ".join(f"CASE WHEN lower({c}) = 'y' THEN 'HIGH' ELSE 'LOW' END" for c in _ESSAY.values()) + "]) AS level FROM essays) GROUP BY trait, level",
)
def trait_strings(spark: SparkSession, d: str) -> DataFrame:
    parsed = essay_labels(spark, d).select(F.explode(L.parse_trait_string("levels")).alias("trait", "level"))
    return parsed.groupBy("trait", "level").agg(F.count("*").alias("n"))
