"""Queries of evidence, containment, search, metrics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import containment, corpora, evidence, features, metrics, retrieval
from loomtext.plans.catalogue import register
from loomtext.plans.corpus_queries import _QUOTES
from loomtext.plans.text_queries import W, sql_sentences, sql_tokens, sql_words
from loomtext.session import table

#: Words that occur in the test corpus; the default lexicon stays that of the operators.
WORDS = ("the", "people", "felt", "learned", "prefer", "loved", "ich", "mich", "que", "mais", "curious", "anxious")
_LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_SCORED = f"""SELECT doc_id, i - 1 AS sentence_idx, s[i] AS sentence FROM (SELECT doc_id, {sql_sentences("text")} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)"""
_SCORES = f"""SELECT doc_id, sentence_idx, sentence, least(1.0, 10.0 * len(list_intersect(list_distinct({sql_tokens("sentence")}), {_LIST})) / greatest(len(list_distinct({sql_tokens("sentence")})), 1))::DOUBLE AS score,
    array_to_string(list_sort(list_intersect(list_distinct({sql_tokens("sentence")}), {_LIST})), ' ') AS matched FROM ({_SCORED})"""


@register("evidence_topk", f"SELECT doc_id, sentence_idx, sentence, round(score, 6) AS score, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence_idx) AS rank FROM ({_SCORES})) WHERE rank <= 3")
def evidence_topk(spark: SparkSession, d: str) -> DataFrame:
    top = evidence.top_sentences(evidence.scored_sentences(table(spark, d, "documents", True), WORDS))
    return top.withColumn("score", F.round("score", 6))


@register("evidence_blend", f"SELECT doc_id, sentence_idx, round(0.7 * least(len({sql_words('sentence')}) / 40.0, 1.0) + 0.3 * score, 6) AS score FROM ({_SCORES})")
def evidence_blend(spark: SparkSession, d: str) -> DataFrame:
    keyword = evidence.scored_sentences(table(spark, d, "documents", True), WORDS)
    by_length = keyword.withColumn("score", F.least(X.word_count("sentence") / 40.0, F.lit(1.0)))
    return evidence.blended(by_length, keyword).select("doc_id", "sentence_idx", F.round("score", 6).alias("score"))


_SQ = f"trim(regexp_replace({{}}, '{W}+', ' ', 'g'), ' ')".replace("{}", "@")


@register(
    "leaked_quotes",
    f"""SELECT DISTINCT doc_id, chunk_id FROM (SELECT doc_id, {_SQ.replace("@", "s")} AS s FROM (SELECT doc_id, unnest({sql_sentences("text")}) AS s FROM documents)) JOIN
        (SELECT chunk_id, {_SQ.replace("@", "text")} AS t FROM kb_chunks WHERE text IS NOT NULL) ON length(s) >= 30 AND contains(t, s)""",
)
def leaked_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the corpus that stand verbatim in a chunk of the knowledge base."""
    sentences = table(spark, d, "documents", True).select("doc_id", F.explode(X.sentences("text")).alias("sentence"))
    found = containment.contained(sentences, table(spark, d, "kb_chunks"), "doc_id", "sentence", "chunk_id", "text")
    return found.distinct()


@register(
    "leak_free_chunks",
    f"""SELECT chunk_id FROM kb_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM (SELECT {_SQ.replace("@", "s")} AS s FROM (SELECT unnest({sql_sentences("utterance")}) AS s FROM dialogue_turns)) JOIN
        (SELECT chunk_id, {_SQ.replace("@", "text")} AS t FROM kb_chunks WHERE text IS NOT NULL) ON length(s) >= 30 AND contains(t, s))""",
)
def leak_free_chunks(spark: SparkSession, d: str) -> DataFrame:
    sentences = table(spark, d, "dialogue_turns").select("utt_id", F.explode(X.sentences("utterance")).alias("sentence"))
    chunks = table(spark, d, "kb_chunks")
    leaks = containment.contained(sentences, chunks, "utt_id", "sentence", "chunk_id", "text")
    return chunks.join(leaks, "chunk_id", "left_anti").select("chunk_id")


@register("quote_grounding", f"{_QUOTES} SELECT trait, round(avg(CASE WHEN quote IS NULL OR quote = '' THEN 0.0 WHEN contains(lower(full_text), lower(quote)) THEN 1.0 ELSE 0.0 END), 6) AS grounding, count(*) AS n FROM (SELECT e.*, coalesce(own, anyone) AS quote FROM e LEFT JOIN q USING (k)) LEFT JOIN (SELECT dialogue_id, string_agg(said, ' ' ORDER BY utt_id, said) AS full_text FROM said GROUP BY 1) USING (dialogue_id) GROUP BY trait")
def quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "dialogue_turns")
    quotes = corpora.evidence_quotes(table(spark, d, "dialogue_evidence"), turns)
    listed = corpora.parsed_turns(turns).groupBy("dialogue_id").agg(F.sort_array(F.collect_list(F.struct("utt_id", "said"))).alias("all"))
    text = listed.select("dialogue_id", F.array_join(F.transform("all", lambda x: x["said"]), " ").alias("full_text"))
    hit = F.when((F.coalesce("quote", F.lit("")) != "") & F.contains(F.lower("full_text"), F.lower("quote")), 1.0).otherwise(0.0)
    return quotes.join(text, "dialogue_id", "left").groupBy("trait").agg(F.round(F.avg(hit), 6).alias("grounding"), F.count("*").alias("n"))


@register("relevance_f1", rf"""{_QUOTES} SELECT dialogue_id, trait, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN b = 0 THEN 0.0 ELSE 2.0 * b / (len(p) + len(g)) END, 6) AS f1 FROM (SELECT *, len(list_intersect(p, g)) AS b FROM (SELECT dialogue_id, trait, list_distinct({sql_tokens("nat")}) AS p, list_distinct({sql_tokens("quote")}) AS g FROM (
    SELECT e.dialogue_id, e.trait, coalesce(own, anyone) AS quote, n.nat FROM e LEFT JOIN q USING (k) JOIN (SELECT row_number() OVER () AS k, nat_lang AS nat FROM dialogue_evidence) n USING (k) WHERE nat IS NOT NULL AND coalesce(own, anyone) IS NOT NULL)))""")
def relevance_f1(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "dialogue_evidence")
    quotes = corpora.evidence_quotes(e.withColumn("trait", F.to_json(F.struct("trait", "nat_lang"))), table(spark, d, "dialogue_turns"))
    both = quotes.select("dialogue_id", F.from_json("trait", "trait string, nat_lang string").alias("t"), "quote").select("dialogue_id", "t.trait", "t.nat_lang", "quote").where("nat_lang IS NOT NULL AND quote IS NOT NULL")
    return both.select("dialogue_id", "trait", F.round(metrics.relevance_f1(both, "nat_lang", "quote"), 6).alias("f1"))


_POST = f"""t AS (SELECT chunk_id, unnest({sql_words("lower(text)")}) AS term FROM kb_chunks WHERE text IS NOT NULL), p AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    l AS (SELECT chunk_id, len({sql_words("lower(text)")}) AS dl FROM kb_chunks WHERE text IS NOT NULL), g AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
    i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, g GROUP BY term, n), m AS (SELECT avg(raw) AS mean FROM i),
    w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM i, m),
    qt AS (SELECT doc_id AS query_id, term, count(*) AS qf FROM (SELECT doc_id, unnest({sql_words("lower(text)")}) AS term FROM documents WHERE doc_id % 50 = 0) GROUP BY 1, 2),
    s AS (SELECT query_id, chunk_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM qt JOIN w USING (term) JOIN p USING (term) JOIN l USING (chunk_id), g GROUP BY 1, 2)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


@register("bm25_topk", f"WITH {_POST} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set, every document whose id is divisible by 50, against all chunks."""
    scored = retrieval.bm25(table(spark, d, "kb_chunks"), _asked(spark, d)).withColumn("score", F.round("score", 9))
    return retrieval.top_k(scored, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))


def _dense(spark: SparkSession, d: str, k: int, metric: str = "cosine") -> DataFrame:
    v = _vectors(spark, d)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.dense(v.select("vec_id", "embedding"), asked, k, metric)


def _dense_sql(score: str) -> str:
    return f"SELECT q.vec_id AS query_id, v.vec_id, round({score}, 9) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v"


_METRICS = {"cosine": "list_cosine_similarity(q.e, v.e)", "dot": "list_inner_product(q.e, v.e)", "euclid": "-list_distance(q.e, v.e)"}


def _register_dense(metric: str) -> None:
    sql = f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_dense_sql(_METRICS[metric])})) WHERE rank <= 10"

    @register(f"dense_topk_{metric}", sql)
    def query(spark: SparkSession, d: str) -> DataFrame:
        hits = _dense(spark, d, 10, metric)
        return hits.select("query_id", "vec_id", (F.round("score", 6) + 0.0).alias("score"), F.col("rank").cast("bigint").alias("rank"))


for _metric in _METRICS:
    _register_dense(_metric)

_FUSED = f"""WITH a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({_dense_sql(_METRICS["cosine"])})),
    b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({_dense_sql(_METRICS["dot"])})),
    f AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.vec_id, y.vec_id) AS vec_id, coalesce(0.7::DOUBLE / (60 + x.r), 0) + coalesce(0.3::DOUBLE / (60 + y.r), 0) AS score, x.r AS ra, y.r AS rb
        FROM (SELECT * FROM a WHERE r <= 20) x FULL JOIN (SELECT * FROM b WHERE r <= 20) y ON x.query_id = y.query_id AND x.vec_id = y.vec_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ra NULLS LAST, rb NULLS LAST, vec_id) AS rank FROM f)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    first, second = (_dense(spark, d, 20, m).withColumnRenamed("vec_id", "chunk_id") for m in ("cosine", "dot"))
    return retrieval.reciprocal_rank_fusion(first, second, 10)


@register("rank_fusion", f"{_FUSED} SELECT query_id, vec_id AS chunk_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("best_of_queries", f"{_FUSED} SELECT vec_id AS chunk_id, round(max(score), 6) AS score, arg_max(query_id, (round(score, 12), -query_id)) AS query_id FROM t WHERE rank <= 10 GROUP BY vec_id")
def best_of_queries(spark: SparkSession, d: str) -> DataFrame:
    hits = _fused(spark, d).withColumn("score", F.round("score", 12))
    return retrieval.best_of_queries(hits).select("chunk_id", F.round("score", 6).alias("score"), "query_id")


@register("search_quality", f"{_FUSED}, h AS (SELECT t.query_id, min(rank) AS first FROM t JOIN embeddings a ON a.vec_id = t.query_id JOIN embeddings b ON b.vec_id = t.vec_id WHERE rank <= 10 AND a.label = b.label AND t.query_id <> t.vec_id GROUP BY 1) SELECT label, count(*) AS n, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1 / first, 0.0)), 6) AS mrr FROM (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 50 = 0) LEFT JOIN h USING (query_id) GROUP BY label")
def search_quality(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _fused(spark, d).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").join(labels.withColumnRenamed("vec_id", "chunk_id"), "chunk_id")
    asked = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return retrieval.evaluate(hits, asked, (F.col("label") == F.col("wanted")) & (F.col("query_id") != F.col("chunk_id")), "label")


# a rule predictor gives the metrics something to measure: the letter of an axis from the text's length
_PRED = "(SELECT doc_id, source, substr(label_mbti, 1, 1) AS y, CASE WHEN n_chars > 450 THEN 'I' ELSE 'E' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'E' ELSE 'I' END AS b FROM documents WHERE label_mbti IS NOT NULL AND n_chars IS NOT NULL)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("label_mbti IS NOT NULL AND n_chars IS NOT NULL")
    return docs.select("doc_id", "source", F.substring("label_mbti", 1, 1).alias("y"), F.when(F.col("n_chars") > 450, "I").otherwise("E").alias("a"), F.when(F.col("doc_id") % 3 == 0, "E").otherwise("I").alias("b"))


def _report_sql(by: str) -> str:
    g = f"{by}, " if by else ""
    on = f" AND c.{by} = l.{by}" if by else ""
    return f"""WITH c AS (SELECT {g}y, a AS p, count(*) AS n FROM {_PRED} GROUP BY ALL), l AS (SELECT DISTINCT {g}unnest([y, p]) AS label FROM c),
        r AS (SELECT {("l." + by + ", ") if by else ""}label, coalesce(sum(n) FILTER (WHERE y = label AND p = label), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (WHERE y = label), 0)::BIGINT AS support, coalesce(sum(n) FILTER (WHERE p = label), 0)::BIGINT AS predicted
            FROM l JOIN c ON (y = label OR p = label){on} GROUP BY ALL),
        f AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM r)"""


@register("confusion_matrix", f"SELECT y, a AS p, count(*) AS n FROM {_PRED} GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(predictions(spark, d), F.col("y"), F.col("a"))


@register("classification_report", f"{_report_sql('')} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.class_report(metrics.confusion(predictions(spark, d), F.col("y"), F.col("a")))
    return r.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


_SUMMARY = """sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision,
    round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy,
    round(coalesce((sum(tp) / sum(support) - sum(support * predicted) / (sum(support) * sum(support))) / nullif(1 - sum(support * predicted) / (sum(support) * sum(support)), 0), 0.0), 6) AS kappa"""


@register("metric_summary", f"{_report_sql('')} SELECT {_SUMMARY} FROM f")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(metrics.class_report(metrics.confusion(predictions(spark, d), F.col("y"), F.col("a"))))


@register("metrics_by_source", f"{_report_sql('source')} SELECT source, {_SUMMARY} FROM f GROUP BY source")
def metrics_by_source(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(metrics.class_report(metrics.confusion(predictions(spark, d), F.col("y"), F.col("a"), ["source"]), ["source"]), ["source"])


@register("metric_ranges", f"{_report_sql('source')}, s AS (SELECT source, {_SUMMARY} FROM f GROUP BY source), u AS (UNPIVOT (SELECT accuracy, macro_f1, kappa FROM s) ON accuracy, macro_f1, kappa INTO NAME metric VALUE v) SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM u GROUP BY metric")
def metric_ranges(spark: SparkSession, d: str) -> DataFrame:
    long = metrics_by_source(spark, d).unpivot("source", ["accuracy", "macro_f1", "kappa"], "metric", "v")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


@register("common_ids", f"SELECT x.doc_id FROM {_PRED} x JOIN (SELECT DISTINCT doc_id FROM {_PRED} WHERE a = b) USING (doc_id)")
def common_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that every method answered alike: here the two rule predictors."""
    long = predictions(spark, d).unpivot(["doc_id", "y"], ["a", "b"], "method", "pred")
    return long.groupBy("doc_id").agg(F.countDistinct("method").alias("m"), F.countDistinct("pred").alias("k")).where("m = 2 AND k = 1").select("doc_id")


@register("method_pairs", f"WITH l AS (SELECT source, 'a' AS method, a = y AS hit FROM {_PRED} UNION ALL SELECT source, 'b', b = y FROM {_PRED}), s AS (SELECT source, method, round(avg(hit::INT), 6) AS accuracy FROM l GROUP BY 1, 2) SELECT x.source, x.method AS first, y.method AS second, round(x.accuracy - y.accuracy, 6) AS gain FROM s x JOIN s y ON x.source = y.source AND x.method < y.method")
def method_pairs(spark: SparkSession, d: str) -> DataFrame:
    long = predictions(spark, d).unpivot(["doc_id", "source", "y"], ["a", "b"], "method", "pred")
    s = long.groupBy("source", "method").agg(F.round(F.avg((F.col("pred") == F.col("y")).cast("int")), 6).alias("accuracy"))
    wide = s.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("method", "accuracy"))).alias("m"))
    # methods of one source: a handful
    first = wide.select("source", F.posexplode("m").alias("i", "x"), "m")
    pairs = first.select("source", "x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    return pairs.select("source", F.col("x.method").alias("first"), F.col("y.method").alias("second"), F.round(F.col("x.accuracy") - F.col("y.accuracy"), 6).alias("gain"))


@register(
    "mcnemar",
    f"""WITH c AS (SELECT count_if(a = y AND b = y) AS both, count_if(a = y AND b <> y) AS only_a, count_if(a <> y AND b = y) AS only_b, count_if(a <> y AND b <> y) AS neither FROM {_PRED}),
        t AS (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))) AS s FROM c, LATERAL (SELECT unnest(range(0, least(only_a, only_b) + 1)) AS k))
        SELECT c.*, round(least(1.0, 2 * s), 6) AS p, least(1.0, 2 * s) < 0.05 AS significant FROM c, t""",
)
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mcnemar(predictions(spark, d), F.col("y"), F.col("a"), F.col("b"))


_DRAW = "(('0x' || substr(md5(doc_id::VARCHAR || '/' || r::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"
_WEIGHT = f"CASE WHEN {_DRAW} < 0.36787944117144233 THEN 0 WHEN {_DRAW} < 0.7357588823428847 THEN 1 WHEN {_DRAW} < 0.9196986029286058 THEN 2 WHEN {_DRAW} < 0.9810118431238462 THEN 3 WHEN {_DRAW} < 0.9963401531726563 THEN 4 WHEN {_DRAW} < 0.9994058151824183 THEN 5 WHEN {_DRAW} < 0.999916758850712 THEN 6 ELSE 7 END"


def _interval_sql(replicates: int) -> str:
    return f"WITH m AS (SELECT r, sum(w * v) / sum(w) AS m FROM (SELECT r, v, {_WEIGHT} AS w FROM (SELECT doc_id, (a = y)::INT::DOUBLE AS v FROM {_PRED}), (SELECT unnest(range(1, {replicates + 1})) AS r)) GROUP BY r) SELECT (SELECT count(*) FROM {_PRED}) AS n, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper, round(stddev_pop(m), 6) AS std FROM m"


@register("bootstrap_interval", _interval_sql(100))
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return metrics.bootstrap(p, F.col("doc_id"), (F.col("a") == F.col("y")).cast("int"), 100)


@register("bootstrap_interval_whole", _interval_sql(1000))
def bootstrap_interval_whole(spark: SparkSession, d: str) -> DataFrame:
    """bootstrap_interval with the reference's 1,000 replicates."""
    p = predictions(spark, d)
    return metrics.bootstrap(p, F.col("doc_id"), (F.col("a") == F.col("y")).cast("int"), 1000)


def _paired_sql(replicates: int) -> str:
    return f"WITH s AS (SELECT doc_id, (a = y)::INT::DOUBLE - (b = y)::INT AS v FROM {_PRED}), m AS (SELECT r, sum(w * v) / sum(w) AS m FROM (SELECT r, v, {_WEIGHT} AS w FROM s, (SELECT unnest(range(1, {replicates + 1})) AS r)) GROUP BY r) SELECT (SELECT count(*) FROM s) AS n, (SELECT round(avg(v), 6) FROM s) AS delta, round(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END), 6) AS p FROM m"


@register("paired_bootstrap", _paired_sql(100))
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return metrics.paired_bootstrap(p, F.col("doc_id"), (F.col("a") == F.col("y")).cast("int"), (F.col("b") == F.col("y")).cast("int"), 100)


@register("paired_bootstrap_whole", _paired_sql(10_000))
def paired_bootstrap_whole(spark: SparkSession, d: str) -> DataFrame:
    """paired_bootstrap with the reference's 10,000 replicates."""
    p = predictions(spark, d)
    return metrics.paired_bootstrap(p, F.col("doc_id"), (F.col("a") == F.col("y")).cast("int"), (F.col("b") == F.col("y")).cast("int"), 10_000)


@register(
    "wilcoxon",
    """WITH s AS (SELECT round(abs(openness - neuroticism), 9) AS m, openness > neuroticism AS up FROM author_profiles WHERE openness IS NOT NULL AND neuroticism IS NOT NULL AND openness <> neuroticism),
        r AS (SELECT up, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS k FROM s) SELECT count(*) AS n, round(coalesce(sum(k) FILTER (WHERE up), 0), 3) AS w_plus, round(coalesce(sum(k) FILTER (WHERE NOT up), 0), 3) AS w_minus,
            round((coalesce(sum(k) FILTER (WHERE up), 0) - count(*) * (count(*) + 1) / 4) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24 - (SELECT sum(t * t * t - t) FROM (SELECT count(*) AS t FROM s GROUP BY m)) / 48), 6) AS z FROM r""",
)
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return metrics.wilcoxon(table(spark, d, "author_profiles"), F.col("openness"), F.col("neuroticism")).select("n", "w_plus", "w_minus", "z")


@register("rating_agreement")
def rating_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the trait levels that different annotations of one speaker give, on the scale LOW, UNKNOWN, HIGH."""
    from loomtext.functions.labels import level

    e = table(spark, d, "dialogue_evidence").select(F.concat_ws("|", "dialogue_id", "speaker").alias("item"), level("level_raw").alias("l"))
    return metrics.krippendorff_ordinal(e.select("item", F.when(F.col("l") == "HIGH", 2).when(F.col("l") == "LOW", 0).otherwise(1).alias("rating")), "item", "rating")


@register("faithfulness", f"""{_QUOTES}, x AS (SELECT dialogue_id, string_agg(said, ' ' ORDER BY utt_id, said) AS t FROM said GROUP BY 1), z AS (SELECT dialogue_id, t, trim(regexp_replace(list_reduce(list_prepend(t, list_sort(list(DISTINCT quote) FILTER (WHERE coalesce(quote, '') <> ''))), lambda acc, qq: replace(acc, qq, ' ')), '{W}+', ' ', 'g'), ' ') AS rest
    FROM x JOIN (SELECT e.dialogue_id, coalesce(own, anyone) AS quote FROM e LEFT JOIN q USING (k)) USING (dialogue_id) GROUP BY dialogue_id, t HAVING count(*) FILTER (WHERE coalesce(quote, '') <> '') > 0)
    SELECT count(*) AS n, count_if(length(rest) < 20) AS skipped, round(avg(CASE WHEN length(rest) >= 20 AND (length(t) > 450) <> (length(rest) > 450) THEN 1.0 ELSE 0.0 END), 6) AS changed FROM z""")
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """How often a rule's answer changes when the quoted evidence is taken out of the text."""
    turns = table(spark, d, "dialogue_turns")
    listed = corpora.parsed_turns(turns).groupBy("dialogue_id").agg(F.sort_array(F.collect_list(F.struct("utt_id", "said"))).alias("all"))
    text = listed.select("dialogue_id", F.array_join(F.transform("all", lambda x: x["said"]), " ").alias("t"))
    quotes = corpora.evidence_quotes(table(spark, d, "dialogue_evidence"), turns).where("coalesce(quote, '') <> ''").groupBy("dialogue_id").agg(F.array_sort(F.collect_set("quote")).alias("quotes"))
    rest = text.join(quotes, "dialogue_id").withColumn("rest", metrics.without_quotes("t", F.col("quotes")))
    changed = (F.length("rest") >= 20) & ((F.length("t") > 450) != (F.length("rest") > 450))
    return rest.agg(F.count("*").alias("n"), F.count_if(F.length("rest") < 20).alias("skipped"), F.round(F.avg(F.when(changed, 1.0).otherwise(0.0)), 6).alias("changed"))


@register("running_metrics", "SELECT event_id, n, errors::BIGINT AS errors, slowest, round(errors / n, 6) AS error_rate FROM (SELECT event_id, count(*) OVER w AS n, sum((event_type = 'error')::INT) OVER w AS errors, max(value) OVER w AS slowest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE n % 20 = 0")
def running_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.running(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("value"))
    return r.where("n % 20 = 0").select("event_id", "n", "errors", "slowest", "error_rate")


@register("latency_quantiles", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("value").alias("most"))


@register("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 450)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(docs.where("n_chars > 450").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@register(
    "tfidf_terms",
    rf"""WITH d AS (SELECT doc_id, {sql_tokens("text")} AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(t || CASE WHEN len(t) > 1 THEN list_transform(list_zip(t[1:len(t) - 1], t[2:len(t)]), lambda x: x[1] || ' ' || x[2]) ELSE [] END) AS term FROM d),
        f AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY 1, 2), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
        w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM f JOIN g USING (term), n WHERE df >= 3 AND df <= 0.95 * n),
        u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
        SELECT doc_id, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS k FROM u) WHERE k <= 5""",
)
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    weights = features.tfidf(table(spark, d, "documents", True)).select("doc_id", F.col("term").alias("chunk_id"), F.round("weight", 9).alias("score"))
    return retrieval.top_k(weights, 5, "doc_id").select("doc_id", F.col("chunk_id").alias("term"), F.round("score", 6).alias("weight"))

