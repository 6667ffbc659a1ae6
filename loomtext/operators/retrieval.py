"""Keyword, vector and fused search, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X

#: A list of queries may be this long to be sent to every partition of the vectors.
BLOCK = 4096


def _terms(c: str) -> Column:
    return X.words(F.lower(c))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "chunk_id", text: str = "text", query_id: str = "query_id", query: str = "query", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, doc_id, score): Okapi BM25 of the documents that share a term with the query.

    Terms are white-space separated and lower case. A negative idf is replaced by epsilon times the mean idf. A term that
    a query repeats counts again. Postings are joined by term, so only matching pairs are made.
    """
    postings = docs.where(F.col(text).isNotNull()).select(doc_id, F.explode(_terms(text)).alias("term")).groupBy(doc_id, "term").agg(F.count("*").alias("tf"))
    lengths = docs.where(F.col(text).isNotNull()).select(doc_id, F.size(_terms(text)).alias("dl"))
    whole = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(whole))  # one row
    idf = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("raw").alias("mean"))
    weight = idf.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")  # one row
    asked = queries.select(query_id, F.explode(_terms(query)).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qf"))
    hits = asked.join(weight, "term").join(postings, "term").join(lengths, doc_id)
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(query_id, doc_id).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "chunk_id") -> DataFrame:
    """The k best hits of each query with rank; ties by doc_id. Limited before the shuffle too."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: The categories in which the chain looks for states and for traits.
STATE_CATEGORIES = ("state_definition", "behavioral_marker", "linguistic_correlate", "evidence_mapping_example")
TRAIT_CATEGORIES = ("trait_definition", "facet_definition", "evidence_mapping_example")


def admitted(chunks: DataFrame, framework: str | None = None, categories: str | tuple[str, ...] | None = None) -> DataFrame:
    """The chunks that a search may return: those of the framework or of both, and of the categories; null admits all.

    Statistics of terms stay those of all chunks: apply this to the hits or to the candidates, not to what is indexed.
    """
    out = chunks
    if framework and framework != "both":
        out = out.where(F.col("framework").isin(framework, "both"))
    if categories:
        out = out.where(F.col("category").isin(*([categories] if isinstance(categories, str) else categories)))
    return out


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int, framework: str | None = None, categories: str | tuple[str, ...] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): BM25 over all chunks, then the filter, then the best k."""
    kept = admitted(chunks, framework, categories).select("chunk_id")
    return top_k(bm25(chunks, queries).withColumn("score", F.round("score", 9)).join(kept, "chunk_id", "left_semi"), k)


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, framework: str | None = None, categories: str | tuple[str, ...] | None = None, size: int = 64) -> DataFrame:
    """(query_id, chunk_id, score, rank): cosine of hashed vectors of query and chunk text, among the chunks that the filter admits."""
    from loomtext.operators.knowledge import hashed_vector

    kept = admitted(chunks, framework, categories)
    vectors = kept.select("chunk_id", hashed_vector(F.col("text"), size).alias("embedding")).where("embedding IS NOT NULL")
    asked = queries.select("query_id", hashed_vector(F.col("query"), size).alias("query")).where("query IS NOT NULL")
    return top_k(dense(vectors, asked, k, vector_id="chunk_id").select("query_id", "chunk_id", F.round("score", 9).alias("score")), k)


def search(chunks: DataFrame, queries: DataFrame, how: str, k: int, framework: str | None = None, categories: str | tuple[str, ...] | None = None, alpha: float = 0.7, pool: int = 2) -> DataFrame:
    """(query_id, chunk_id, score, rank) by one retriever: keyword, semantic, hybrid or none.

    hybrid fuses the ranks of the best pool * k hits of vectors and keywords over the same chunks; none finds nothing.
    """
    if how == "keyword":
        return keyword_search(chunks, queries, k, framework, categories)
    if how == "semantic":
        return vector_search(chunks, queries, k, framework, categories)
    if how == "hybrid":
        return reciprocal_rank_fusion(vector_search(chunks, queries, pool * k, framework, categories), keyword_search(chunks, queries, pool * k, framework, categories), k, alpha)
    if how == "none":
        return keyword_search(chunks, queries, k, framework, categories).limit(0)
    raise ValueError(f"unknown retriever {how}")


def gold_match(trait: str = "expected_trait", category: str = "expected_category", pole: str = "expected_pole") -> Column:
    """Whether a hit (trait, category, pole) is what its query expects; an expectation that is null holds for every hit.

    A pole is met by the same pole or by BOTH.
    """
    same = lambda want, has: F.col(want).isNull() | F.coalesce(F.col(has) == F.col(want), F.lit(False))
    return same(trait, "trait") & same(category, "category") & (same(pole, "pole") | F.coalesce(F.col("pole") == "BOTH", F.lit(False)))


def misses(hits: DataFrame, queries: DataFrame, match: Column, k: int = 5) -> DataFrame:
    """(query_id, top ARRAY): the queries that no hit of theirs meets, with their first k hits."""
    met = hits.where(match).select("query_id").distinct()
    top = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("top"))
    return queries.select("query_id").join(met, "query_id", "left_anti").join(top, "query_id", "left")


def used_chunks(state_hits: DataFrame, trait_hits: DataFrame, chunks: DataFrame, limit: int = 20, width: int = 200) -> DataFrame:
    """(query_id, place, chunk_id, shown): the chunks that a prompt is given: hits for states, then for traits, each once.

    At most `limit` chunks of a query, of each the first `width` characters.
    """
    both = state_hits.select("query_id", "chunk_id", F.lit(0).alias("stage"), "rank").unionByName(trait_hits.select("query_id", "chunk_id", F.lit(1).alias("stage"), "rank"))
    once = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("stage", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "chunk_id")
    placed = once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return placed.join(chunks.select("chunk_id", F.substring("text", 1, width).alias("shown")), "chunk_id").select("query_id", F.col("place").cast("bigint").alias("place"), "chunk_id", "shown")


def dense(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vector_id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, vec_id, score, rank): exact search of a stated list of queries against all vectors, block by block.

    Each partition of the vectors multiplies them with blocks of at most BLOCK queries and keeps the block's best k of
    each query, so what is shuffled is k rows for each query and partition. Null vectors match nothing.
    """
    from loomtext.operators.vectors import blockwise_top_k

    return top_k(blockwise_top_k(vectors.select(vector_id, vector), queries.select(query_id, query), k, metric, BLOCK), k, query_id, vector_id)


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int, alpha: float = 0.7, c: int = 60, query_id: str = "query_id", doc_id: str = "chunk_id") -> DataFrame:
    """(query_id, doc_id, score, rank): alpha / (c + rank in first) + (1 - alpha) / (c + rank in second), ranks from 1."""
    a = first.select(query_id, doc_id, F.col("rank").alias("rank_a"))
    b = second.select(query_id, doc_id, F.col("rank").alias("rank_b"))
    joined = a.join(b, [query_id, doc_id], "full_outer")
    score = F.coalesce(alpha / (c + F.col("rank_a")), F.lit(0.0)) + F.coalesce((1 - alpha) / (c + F.col("rank_b")), F.lit(0.0))
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), F.col("rank_a").asc_nulls_last(), F.col("rank_b").asc_nulls_last(), doc_id)
    return joined.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, doc_id, "score", "rank")


def best_of_queries(hits: DataFrame, doc_id: str = "chunk_id") -> DataFrame:
    """Each document once, with its best score and the first query that has it."""
    best = F.max_by(F.struct("score", "query_id"), F.struct("score", (-F.col("query_id")).alias("q")))
    return hits.groupBy(doc_id).agg(best.alias("b")).select(doc_id, F.col("b.score").alias("score"), F.col("b.query_id").alias("query_id"))


def evaluate(hits: DataFrame, queries: DataFrame, match: Column, by: str) -> DataFrame:
    """(by, n, recall_3, recall_5, mrr) of ranked hits; a query without a matching hit counts 0."""
    first = hits.where(match).groupBy("query_id").agg(F.min("rank").alias("first"))
    joined = queries.select("query_id", by).join(first, "query_id", "left")
    rate = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6)
    return joined.groupBy(by).agg(F.count("*").alias("n"), rate(3).alias("recall_3"), rate(5).alias("recall_5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
