"""Queries of models: search of settings, bags, votes, curves, features and components. No SQL: the fits are iterative."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import evidence, models
from loomtext.plans.catalogue import register
from loomtext.plans.knowledge_queries import _evaluated, _labelled
from loomtext.session import table, written


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return written(models.with_vector(v, "embedding", F.col("label").cast("int") % 2).select("vec_id", "features", "y", "w"), "vectors")


@register("model_grid")
def model_grid(spark: SparkSession, d: str) -> DataFrame:
    return models.grid_search(_vectors(spark, d))


@register("model_bagged_svm")
def model_bagged_svm(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    fitted = models.bagged(rows.where("vec_id % 3 <> 0"), "vec_id")
    votes = models.hard_vote(fitted, rows.where("vec_id % 3 = 0"), "vec_id")
    return _evaluated(votes.join(rows.select("vec_id", F.col("y").cast("int").alias("label")), "vec_id"))


@register("model_curve")
def model_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return models.learning_curve(rows.where("vec_id % 3 <> 0"), rows.where("vec_id % 3 = 0"))


@register("model_stop")
def model_stop(spark: SparkSession, d: str) -> DataFrame:
    return models.stopped(model_curve(spark, d))


@register("model_components")
def model_components(spark: SparkSession, d: str) -> DataFrame:
    """The lengths of all vectors in their first eight principal components."""
    from pyspark.ml.functions import vector_to_array

    done, _ = models.reduced(_vectors(spark, d), 8)
    x = vector_to_array("reduced")
    return done.select("vec_id", F.round(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)), 6).alias("length"))


@register("model_top_features")
def model_top_features(spark: SparkSession, d: str) -> DataFrame:
    rows = written(_labelled(spark, d), "rows")
    return models.top_features(models.fit_text(rows.where("NOT held"), "lr", "label"))


@register("supervised_sentences")
def supervised_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all texts scored by models of two axes, blended with their keyword scores."""
    rows = written(_labelled(spark, d), "rows").join(table(spark, d, "documents").select("doc_id", F.substring("label_mbti", 3, 1).alias("second")), "doc_id")
    train = written(rows.where("NOT held"), "train")
    fitted = {name: models.fit_text(train.select("text", F.col(c).alias("axis")), "lr", "axis") for name, c in (("IE", "label"), ("TF", "second"))}
    keyword = evidence.scored_sentences(table(spark, d, "documents", True))
    scored = models.sentence_scores(fitted, keyword)
    return evidence.blended(scored, keyword).select("doc_id", "sentence_idx", F.round("score", 6).alias("score"), "label_IE", "label_TF")
