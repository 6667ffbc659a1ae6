"""Queries of corpora, profiles, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import text as X
from loomtext.operators import corpora, features, profile, sampling
from loomtext.plans.catalogue import register
from loomtext.plans.text_queries import W, sql_clean, sql_strip, sql_words
from loomtext.session import table

TYPES = X.MBTI_TYPES
_SPLIT = f"CASE WHEN s IN ('train', 'training') THEN 'train' WHEN s IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN s = 'test' THEN 'test' END"
_DOCS = f"(SELECT * EXCLUDE (split), {_SPLIT} AS split FROM (SELECT *, lower({sql_strip('split')}) AS s FROM documents))"


def split_of(column: str = "split"):
    s = F.lower(X.strip(column))
    return F.when(s.isin("train", "training"), "train").when(s.isin("val", "valid", "validation", "dev"), "val").when(s == "test", "test")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", True).withColumn("split", split_of())


_FORUM = rf"""SELECT row_id, 'mbti_' || substr(md5(posts), 1, 8) AS id, array_to_string(kept, ' ') AS text, label_mbti, len(kept)::BIGINT AS n_posts,
    round(list_sum(list_transform(kept, lambda p: len({sql_words("p")}))) / len(kept), 6) AS mean_words FROM (
    SELECT row_id, posts, upper({sql_strip("mbti_type")}) AS label_mbti,
        list_filter(list_transform(string_split(regexp_replace(posts, '^''|''$', '', 'g'), '|||'), lambda p: {sql_clean("p")}), lambda p: len({sql_words("p")}) >= 10) AS kept
    FROM forum_types) WHERE label_mbti IN {TYPES} AND len(kept) > 0"""


@register("forum_records", _FORUM)
def forum_records(spark: SparkSession, d: str) -> DataFrame:
    """Without the normal form, which DuckDB lacks; forum_records_normal is the whole job."""
    return corpora.forum_records(table(spark, d, "forum_types"), normalize=False)


@register("forum_records_normal")
def forum_records_normal(spark: SparkSession, d: str) -> DataFrame:
    return corpora.forum_records(table(spark, d, "forum_types"))


@register("latest_comments", "SELECT comment_id, arg_max(body, (ingested_at, coalesce(body, ''), coalesce(lang, ''), coalesce(author, ''))) AS body, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S.%f') AS ingested_at FROM comments WHERE comment_id IS NOT NULL GROUP BY comment_id".replace("arg_max(body", "arg_max(coalesce(body, '<null>')"))
def latest_comments(spark: SparkSession, d: str) -> DataFrame:
    out = corpora.latest_comments(table(spark, d, "comments"))
    return out.select("comment_id", F.coalesce("body", F.lit("<null>")).alias("body"), F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ingested_at"))


_AUTHORS = f"""SELECT author, max(label_mbti) AS label_mbti, bool_or(complete) AS complete FROM (
    SELECT {sql_strip("author")} AS author, CASE WHEN upper({sql_strip("mbti")}) IN {TYPES} THEN upper({sql_strip("mbti")}) END AS label_mbti,
        openness IS NOT NULL AND conscientiousness IS NOT NULL AND extraversion IS NOT NULL AND agreeableness IS NOT NULL AND neuroticism IS NOT NULL AS complete FROM author_profiles)
    WHERE author <> '' GROUP BY author HAVING max(label_mbti) IS NOT NULL OR bool_or(complete)"""
_FC = rf"{sql_strip(rf'''regexp_replace(regexp_replace(regexp_replace(body, '(?m)^>.*$', '', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '#+{W}*', '', 'g')''')}"
_USABLE = f"""SELECT comment_id, author, cleaned FROM (SELECT comment_id, {sql_strip("author")} AS author, {sql_clean(_FC)} AS cleaned FROM comments
    WHERE body IS NOT NULL AND lang = 'en' AND {sql_strip("body")} <> '' AND NOT ({" OR ".join(f"contains(lower(body), '{p}')" for p in X.BOT_PHRASES)}))
    WHERE len({sql_words("cleaned")}) >= 5 AND author IN (SELECT author FROM a)"""


@register("eligible_authors", _AUTHORS)
def eligible_authors(spark: SparkSession, d: str) -> DataFrame:
    return corpora.eligible_authors(table(spark, d, "author_profiles"))


@register(
    "author_records",
    f"""WITH a AS ({_AUTHORS}), u AS ({_USABLE}), r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY md5(comment_id::VARCHAR), comment_id) AS k FROM u)
        SELECT 'pandora_' || substr(md5(author), 1, 8) AS id, author, label_mbti, n_sampled, n_total, md5(text) AS text_md5 FROM
        (SELECT author, string_agg(cleaned, ' ' ORDER BY k, cleaned) AS text, count(*) AS n_sampled FROM r WHERE k <= 100 GROUP BY author)
        JOIN (SELECT author, count(*) AS n_total FROM u GROUP BY author) USING (author) JOIN a USING (author)""",
)
def author_records(spark: SparkSession, d: str) -> DataFrame:
    """Without the normal form, which DuckDB lacks; author_records_normal is the whole job."""
    out = corpora.author_records(table(spark, d, "comments", True), table(spark, d, "author_profiles"), normalize=False)
    return out.select("id", "author", "label_mbti", "n_sampled", "n_total", F.md5("text").alias("text_md5"))


@register("author_records_normal")
def author_records_normal(spark: SparkSession, d: str) -> DataFrame:
    return corpora.author_records(table(spark, d, "comments", True), table(spark, d, "author_profiles"))


_SAID = f"""SELECT DISTINCT dialogue_id, coalesce(speaker, 'UNKNOWN') AS speaker, utt_id, {sql_strip(rf"regexp_replace(regexp_replace({sql_strip('utterance')}, '^Utterance[ \t]+[0-9]+[ \t]+.+?[ \t]+said:{W}*', ''), '^第[0-9]+句.+?说[：:]', '')")} AS said
    FROM dialogue_turns WHERE utterance IS NOT NULL AND dialogue_id IS NOT NULL"""


@register("speaker_records", f"SELECT 'personality_evd_' || substr(md5(dialogue_id || '|' || speaker), 1, 8) AS id, dialogue_id, speaker, string_agg(said, ' ' ORDER BY utt_id, said) AS text, count(*) AS n_utterances FROM ({_SAID}) GROUP BY dialogue_id, speaker")
def speaker_records(spark: SparkSession, d: str) -> DataFrame:
    return corpora.speaker_records(table(spark, d, "dialogue_turns"))


_LEVEL = "CASE WHEN lower(level_raw) LIKE '%high%' OR level_raw LIKE '%高%' THEN 'HIGH' WHEN lower(level_raw) LIKE '%low%' OR level_raw LIKE '%低%' THEN 'LOW' ELSE 'UNKNOWN' END"
_QUOTES = f"""WITH said AS ({_SAID}), e AS (SELECT row_number() OVER () AS k, dialogue_id, speaker, trait, {_LEVEL} AS level, utt_ids FROM dialogue_evidence),
    f AS (SELECT DISTINCT k, speaker AS target, u, dialogue_id FROM (SELECT *, unnest(utt_ids) AS u FROM e)),
    q AS (SELECT k, nullif(string_agg(said, ' ' ORDER BY u, said) FILTER (WHERE s.speaker = target), '') AS own, string_agg(said, ' ' ORDER BY u, said) AS anyone
        FROM f JOIN said s ON s.dialogue_id = f.dialogue_id AND s.utt_id = f.u GROUP BY k)"""


@register("evidence_quotes", f"{_QUOTES} SELECT dialogue_id, speaker, trait, level, coalesce(own, anyone) AS quote FROM e LEFT JOIN q USING (k)")
def evidence_quotes(spark: SparkSession, d: str) -> DataFrame:
    return corpora.evidence_quotes(table(spark, d, "dialogue_evidence"), table(spark, d, "dialogue_turns"))


@register("evidence_coverage", f"{_QUOTES} SELECT trait, level, count(*) AS items, count(nullif(coalesce(own, anyone), '')) AS with_quote, count_if(len(utt_ids) > 0) AS with_ids, count(DISTINCT dialogue_id) AS dialogues FROM e LEFT JOIN q USING (k) GROUP BY trait, level")
def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "dialogue_evidence")
    q = corpora.evidence_quotes(e, table(spark, d, "dialogue_turns"))
    ids = e.select("trait", L.level("level_raw").alias("level"), F.when(F.size("utt_ids") > 0, 1).alias("has")).groupBy("trait", "level").agg(F.count("has").alias("with_ids"))
    main = q.groupBy("trait", "level").agg(F.count("*").alias("items"), F.count(F.nullif("quote", F.lit(""))).alias("with_quote"), F.countDistinct("dialogue_id").alias("dialogues"))
    return main.join(ids, ["trait", "level"])


@register("level_by_trait", f"SELECT trait, count_if({_LEVEL} = 'HIGH') AS high, count_if({_LEVEL} = 'LOW') AS low, count_if({_LEVEL} = 'UNKNOWN') AS unknown, round(100.0 * count_if({_LEVEL} = 'HIGH') / nullif(count_if({_LEVEL} IN ('HIGH', 'LOW')), 0), 2) AS high_pct FROM dialogue_evidence GROUP BY trait")
def level_by_trait(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "dialogue_evidence").select("trait", L.level("level_raw").alias("level")).groupBy("trait").pivot("level", ["HIGH", "LOW", "UNKNOWN"]).count().na.fill(0, ["HIGH", "LOW", "UNKNOWN"])
    return wide.select("trait", F.col("HIGH").alias("high"), F.col("LOW").alias("low"), F.col("UNKNOWN").alias("unknown"), F.round(F.try_divide(100.0 * F.col("HIGH"), F.col("HIGH") + F.col("LOW")), 2).alias("high_pct"))


@register("corpus_stats", f"SELECT source, count(*) AS n, count(label_mbti) AS labelled, round(sum(len({sql_words('text')})) / greatest(count(*), 1), 6) AS mean_words FROM documents GROUP BY source")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count("label_mbti").alias("labelled"), F.round(F.sum(F.when(F.col("text").isNotNull(), X.word_count("text"))) / F.greatest(F.count("*"), F.lit(1)), 6).alias("mean_words"))


def _profile_sql(value: str, by: str, source: str) -> str:
    q = ", ".join(f"quantile_disc(v, {x})::BIGINT AS p{round(x * 100)}" for x in (0.25, 0.75, 0.9, 0.95, 0.99))
    return f"SELECT g0, count(*) AS n, min(v) AS least, floor(quantile_cont(v, 0.5))::BIGINT AS median, round(avg(v), 2) AS mean, max(v) AS most, {q} FROM (SELECT {by} AS g0, ({value})::BIGINT AS v FROM {source}) WHERE v IS NOT NULL GROUP BY g0"


@register("length_by_lang", _profile_sql("n_chars", "lang", "documents"))
def length_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return profile.length_profile(table(spark, d, "documents"), F.col("n_chars"), [F.col("lang")])


@register("words_by_split", _profile_sql(f"len({sql_words('text')})", "split", _DOCS))
def words_by_split(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).where("text IS NOT NULL")
    return profile.length_profile(docs, X.word_count("text"), [F.col("split")])


@register("comment_lengths", _profile_sql("length(body)", "subreddit", "comments"))
def comment_lengths(spark: SparkSession, d: str) -> DataFrame:
    return profile.length_profile(table(spark, d, "comments").where("body IS NOT NULL"), F.length("body"), [F.col("subreddit")])


@register("label_distribution", "SELECT label_mbti AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM documents WHERE label_mbti IS NOT NULL GROUP BY label_mbti")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(table(spark, d, "documents"), F.col("label_mbti"))


@register("label_imbalance", "WITH c AS (SELECT label_mbti AS l, count(*) AS n FROM documents WHERE label_mbti IS NOT NULL GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS classes, (SELECT l FROM c ORDER BY n DESC, l LIMIT 1) AS majority, (SELECT l FROM c ORDER BY n, l LIMIT 1) AS minority, round(max(n) / min(n), 2) AS ratio FROM c")
def label_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return profile.imbalance(profile.distribution(table(spark, d, "documents"), F.col("label_mbti")))


@register("axis_distribution", "SELECT axis, letter, count(*) AS n FROM (SELECT unnest(['IE', 'SN', 'TF', 'JP']) AS axis, unnest([substr(label_mbti, 1, 1), substr(label_mbti, 2, 1), substr(label_mbti, 3, 1), substr(label_mbti, 4, 1)]) AS letter FROM documents WHERE length(label_mbti) = 4) GROUP BY axis, letter")
def axis_distribution(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("length(label_mbti) = 4")
    return docs.select(F.explode(F.create_map(*(x for a, k in L.AXES for x in (F.lit(a), F.substring("label_mbti", k, 1))))).alias("axis", "letter")).groupBy("axis", "letter").agg(F.count("*").alias("n"))


@register("split_counts", f"SELECT source, count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test, count_if(split IS NULL) AS none FROM {_DOCS} GROUP BY source")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("source").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")), F.count_if(F.col("split").isNull()).alias("none"))


@register("text_stats", f"SELECT source, count(*) AS n, count_if(text IS NULL OR text = '') AS empty, count_if(w > 512) AS over_512, count_if(w > 2000) AS over_2000, round(100.0 * count_if(w > 512) / count(*), 2) AS over_512_pct FROM (SELECT source, text, len({sql_words('text')}) AS w FROM documents) GROUP BY source")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "text", X.word_count("text").alias("w"))
    return docs.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.expr("text IS NULL OR text = ''")).alias("empty"), F.count_if(F.expr("w > 512")).alias("over_512"), F.count_if(F.expr("w > 2000")).alias("over_2000"), L.percent(F.count_if(F.expr("w > 512")), F.count("*")).alias("over_512_pct")
    )


_T = "|".join(TYPES)


@register(
    "leakage_stats",
    rf"""SELECT count(*) AS n, count_if(regexp_matches(text, '(?i)\b({_T})(s|es)?\b')) AS any_type, count_if(list_contains(list_transform(regexp_extract_all(text, '(?i)\b({_T})(s|es)?\b', 1), lambda x: upper(x)), upper(label_mbti))) AS own_type,
        count_if(regexp_matches(text, '{profile.MBTI_TERMS}')) AS mbti_terms, count_if(regexp_matches(text, '{profile.OCEAN_TERMS}')) AS ocean_terms, count_if(regexp_matches(text, '(?i){X.URL}')) AS urls, count_if(regexp_matches(text, '{X.MENTION}')) AS mentions FROM documents""",
)
def leakage_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.leakage_stats(table(spark, d, "documents"))


@register("term_breakdown", " UNION ALL ".join(rf"SELECT source AS grp, '{k}' AS term, count_if(regexp_matches(text, '{p}')) AS n FROM documents GROUP BY source" for k, p in profile.TERM_PATTERNS.items()))
def term_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return profile.term_breakdown(table(spark, d, "documents"), F.col("source"))


_SCORES = " + ".join(f"({c} IS NOT NULL)::INT" for c in L.TRAIT_NAMES.values())


@register("ocean_completeness", f"SELECT CASE WHEN k = 5 THEN 'complete' WHEN k = 0 THEN 'missing' ELSE 'partial' END AS state, count(*) AS n FROM (SELECT {_SCORES} AS k FROM author_profiles) GROUP BY state")
def ocean_completeness(spark: SparkSession, d: str) -> DataFrame:
    k = sum((F.col(c).isNotNull().cast("int") for c in L.TRAIT_NAMES.values()), F.lit(0))
    return table(spark, d, "author_profiles").groupBy(F.when(k == 5, "complete").when(k == 0, "missing").otherwise("partial").alias("state")).agg(F.count("*").alias("n"))


@register("exact_duplicates", "SELECT sum(c)::BIGINT AS rows, count(*) AS distinct, count_if(c > 1) AS repeated, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT AS rows_in_repeats FROM (SELECT count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY md5(text))".replace("AS distinct", 'AS "distinct"').replace("AS rows,", 'AS "rows",'))
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicates(table(spark, d, "documents"), F.md5("text"))


_NEAR = f"md5(substr(regexp_replace({sql_strip('lower(text)')}, '{W}+', ' ', 'g'), 1, 200))"


@register("near_duplicates", f'SELECT sum(c)::BIGINT AS "rows", count(*) AS "distinct", count_if(c > 1) AS repeated, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT AS rows_in_repeats FROM (SELECT count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY {_NEAR})')
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicates(table(spark, d, "documents", True), X.near_hash("text"))


@register("cross_split_overlap", f"SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM (SELECT DISTINCT split, {_NEAR} AS k FROM {_DOCS} WHERE split IS NOT NULL AND text IS NOT NULL) a JOIN (SELECT DISTINCT split, {_NEAR} AS k FROM {_DOCS} WHERE split IS NOT NULL AND text IS NOT NULL) b ON a.k = b.k AND a.split < b.split GROUP BY 1, 2")
def cross_split_overlap(spark: SparkSession, d: str) -> DataFrame:
    return sampling.cross_split_counts(documents(spark, d), F.col("split"), X.near_hash("text"))


@register("split_analysis", f"SELECT split, count(*) AS n, count(DISTINCT label_mbti) AS types, count(text) - count(DISTINCT md5(text)) AS exact_repeats, count(text) - count(DISTINCT {_NEAR}) AS near_repeats FROM {_DOCS} GROUP BY split")
def split_analysis(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    main = docs.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("label_mbti").alias("types"), F.count("text").alias("texts"))
    # a count per key first, so that no distinct set is gathered in one task
    keys = lambda c, name: docs.select("split", c.alias("k")).where("k IS NOT NULL").distinct().groupBy("split").agg(F.count("*").alias(name))
    joined = main.join(keys(F.md5("text"), "e").withColumnRenamed("split", "s1"), F.col("split").eqNullSafe(F.col("s1")), "left").join(keys(X.near_hash("text"), "h").withColumnRenamed("split", "s2"), F.col("split").eqNullSafe(F.col("s2")), "left")
    return joined.select("split", "n", "types", (F.col("texts") - F.coalesce("e", F.lit(0))).alias("exact_repeats"), (F.col("texts") - F.coalesce("h", F.lit(0))).alias("near_repeats"))


@register("forum_profile", rf"SELECT mbti_type, count(*) AS users, sum(len(p))::BIGINT AS posts, count_if(regexp_matches(posts, '(?i)\b({_T})(s|es)?\b')) AS leaking_users, sum(len(list_filter(p, lambda x: regexp_matches(x, '(?i)\b({_T})(s|es)?\b'))))::BIGINT AS leaking_posts FROM (SELECT mbti_type, posts, string_split(regexp_replace(posts, '^''|''$', '', 'g'), '|||') AS p FROM forum_types WHERE posts IS NOT NULL) GROUP BY mbti_type")
def forum_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "forum_types").where("posts IS NOT NULL").withColumn("p", F.split(F.regexp_replace("posts", "^'|'$", ""), r"\|\|\|"))
    leaks = lambda c: c.rlike(X.TYPE_MENTION)
    return rows.groupBy("mbti_type").agg(F.count("*").alias("users"), F.sum(F.size("p")).alias("posts"), F.count_if(leaks(F.col("posts"))).alias("leaking_users"), F.sum(F.size(F.filter("p", leaks))).alias("leaking_posts"))


@register("essay_profile", "SELECT count(*) AS n, count(DISTINCT authid) AS authors, " + ", ".join(f"count_if(lower({c}) = 'y') AS {c}_yes, count_if(lower({c}) = 'n') AS {c}_no" for c in ("copn", "ccon", "cext", "cagr", "cneu")) + " FROM essays")
def essay_profile(spark: SparkSession, d: str) -> DataFrame:
    flags = ("copn", "ccon", "cext", "cagr", "cneu")
    return table(spark, d, "essays").agg(F.count("*").alias("n"), F.countDistinct("authid").alias("authors"), *(F.count_if(F.lower(c) == v).alias(f"{c}_{n}") for c in flags for v, n in (("y", "yes"), ("n", "no"))))


@register("author_profile_counts", f"SELECT count(*) AS n, count_if(upper({sql_strip('mbti')}) IN {TYPES}) AS valid_types, count_if({_SCORES} = 5) AS complete FROM author_profiles")
def author_profile_counts(spark: SparkSession, d: str) -> DataFrame:
    k = sum((F.col(c).isNotNull().cast("int") for c in L.TRAIT_NAMES.values()), F.lit(0))
    return table(spark, d, "author_profiles").agg(F.count("*").alias("n"), F.count_if(L.mbti("mbti").isNotNull()).alias("valid_types"), F.count_if(k == 5).alias("complete"))


@register("dialogue_profile", "SELECT dialogue_id, count(DISTINCT speaker) AS speakers, count(*) AS turns, coalesce(any_value(items), 0) AS items FROM dialogue_turns LEFT JOIN (SELECT dialogue_id, count(*) AS items FROM dialogue_evidence GROUP BY 1) USING (dialogue_id) GROUP BY dialogue_id")
def dialogue_profile(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "dialogue_evidence").groupBy("dialogue_id").agg(F.count("*").alias("items"))
    turns = table(spark, d, "dialogue_turns").groupBy("dialogue_id").agg(F.countDistinct("speaker").alias("speakers"), F.count("*").alias("turns"))
    return turns.join(items, "dialogue_id", "left").na.fill(0, ["items"])


@register("score_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM author_profiles" for i, a in enumerate(L.TRAIT_NAMES.values()) for b in list(L.TRAIT_NAMES.values())[i + 1 :]))
def score_correlations(spark: SparkSession, d: str) -> DataFrame:
    return profile.pearson(table(spark, d, "author_profiles"), list(L.TRAIT_NAMES.values()))


@register("lineitem_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def lineitem_correlations(spark: SparkSession, d: str) -> DataFrame:
    return profile.pearson(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@register("combo_counts", "SELECT combo, count(*) AS n FROM (SELECT " + " || ".join(f"CASE WHEN lower({c}) = 'y' THEN '1' ELSE '0' END" for c in ("copn", "ccon", "cext", "cagr", "cneu")) + " AS combo FROM essays) GROUP BY combo ORDER BY n DESC, combo LIMIT 8")
def combo_counts(spark: SparkSession, d: str) -> DataFrame:
    levels = dict(zip(L.TRAITS, (L.yes_no_level(c) for c in ("copn", "ccon", "cext", "cagr", "cneu")), strict=True))
    return table(spark, d, "essays").groupBy(L.combo(levels).alias("combo")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combo").limit(8)


@register("class_weights", "WITH c AS (SELECT label_mbti AS label, count(*) AS n FROM documents WHERE label_mbti IS NOT NULL GROUP BY 1), w AS (SELECT sum(n) AS t, count(*) AS k FROM c) SELECT label, n, round(t / (k * n), 6) AS balanced, round(least(greatest(sqrt(t / (k * n)), 0.5), 2.0), 6) AS sqrt_balanced, round(1 / n, 6) AS sampling FROM c, w")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return features.class_weights(table(spark, d, "documents"), "label_mbti")


@register("length_histogram", "SELECT least(floor(log10(n) / log10(100000) * 50)::INTEGER + 1, 51) AS bin, count(*) AS n FROM (SELECT n_chars AS n FROM documents WHERE n_chars >= 1) GROUP BY bin".replace("count(*) AS n FROM", "count(*) AS m FROM").replace("AS m FROM", "AS n FROM"))
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.log_histogram(table(spark, d, "documents"), F.col("n_chars"), 50, 100_000).withColumn("bin", F.col("bin").cast("int"))


@register("dataset_hash")
def dataset_hash(spark: SparkSession, d: str) -> DataFrame:
    return profile.dataset_hash(table(spark, d, "documents"), ["doc_id", "text", "source", "split"])


@register(
    "stratified_split",
    """WITH r AS (SELECT doc_id, coalesce(label_mbti, '<null>') AS s, row_number() OVER (PARTITION BY coalesce(label_mbti, '<null>') ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY coalesce(label_mbti, '<null>')) AS n FROM documents)
        SELECT doc_id, CASE WHEN k <= ceil(ceil(n * 0.3::DOUBLE) / 2) THEN 'val' WHEN k <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM r""",
)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "label_mbti")
    return sampling.stratified_split(docs, F.col("doc_id"), F.col("label_mbti")).select("doc_id", "part")


@register("capped_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 20")
def capped_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.capped_sample(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], F.col("doc_id"), 20).select("doc_id", "source")


@register("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 500")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), 500)
