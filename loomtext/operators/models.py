"""Classifiers on TF-IDF features and vectors, with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, CountVectorizerModel, IDFModel, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import metrics, tasks

#: Builders by name; labels are indexed and weighted before.
CLASSIFIERS = {
    "lr": lambda: LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", maxIter=50),
    "nb": lambda: NaiveBayes(featuresCol="features", labelCol="y", weightCol="w"),
    "rf": lambda: RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w", numTrees=20, maxDepth=6, seed=42),
    "svm": lambda: LinearSVC(featuresCol="features", labelCol="y", weightCol="w", maxIter=50),
}


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with w = n / (classes x class size)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    whole = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    weights = counts.join(F.broadcast(whole)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("w"))  # one row
    return rows.join(weights, label)


def text_pipeline(classifier: str, label: str, text: str = "text", features: int = 15_000, min_df: int = 3, max_df: float = 0.9) -> Pipeline:
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"),
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False),
            NGram(n=2, inputCol="_words", outputCol="_pairs"),
            CountVectorizer(inputCol="_words", outputCol="_tf1", vocabSize=features, minDF=min_df, maxDF=max_df),
            CountVectorizer(inputCol="_pairs", outputCol="_tf2", vocabSize=features, minDF=min_df, maxDF=max_df),
            VectorAssembler(inputCols=["_tf1", "_tf2"], outputCol="_tf"),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="features"),
            CLASSIFIERS[classifier](),
        ]
    )


def fit_text(train: DataFrame, classifier: str, label: str, **settings: float) -> PipelineModel:
    """The fitted pipeline, label index included, so that what is saved predicts labels again."""
    return text_pipeline(classifier, label, **settings).fit(balanced(train, label))


def predict_labels(model: PipelineModel, rows: DataFrame) -> DataFrame:
    names = model.stages[0].labels
    done = model.transform(rows.withColumn("w", F.lit(1.0)) if "w" not in rows.columns else rows)
    return done.withColumn("predicted", F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1))


def soft_vote(models: list[PipelineModel], rows: DataFrame, id_col: str) -> DataFrame:
    """(id_col, predicted): the label with the greatest mean probability."""
    summed = rows.select(id_col)
    for k, m in enumerate(models):
        p = m.transform(rows.withColumn("w", F.lit(1.0))).select(id_col, vector_to_array("probability").alias(f"p{k}"))
        summed = summed.join(p, id_col)
    total = F.col("p0")
    for k in range(1, len(models)):
        total = F.zip_with(total, F.col(f"p{k}"), lambda a, b: a + b)
    best = F.array_position(total, F.array_max(total)).cast("int")
    return summed.select(id_col, F.element_at(F.array(*map(F.lit, models[0].stages[0].labels)), best).alias("predicted"))


def fit_vectors(train: DataFrame, vector: str, label: str, classes: int, layers: tuple[int, ...] = (16,)) -> tuple[MultilayerPerceptronClassifier, DataFrame]:
    width = train.select(F.max(F.size(vector))).first()[0]
    data = train.select("*", array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("y"))
    model = MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=[width, *layers, classes], seed=42, maxIter=60).fit(data)
    return model, data


def with_vector(rows: DataFrame, vector: str, label: Column, name: str = "features") -> DataFrame:
    """rows with a vector column of doubles, y and w = 1; null vectors and labels are left out."""
    ready = rows.where(F.col(vector).isNotNull()).withColumns({name: array_to_vector(F.transform(vector, lambda x: x.cast("double"))), "y": label.cast("double"), "w": F.lit(1.0)})
    return ready.where("y IS NOT NULL")


def grid_search(rows: DataFrame, strengths: tuple[float, ...] = (0.001, 0.01, 0.1), folds: int = 5) -> DataFrame:
    """(strength, macro_f1, rank) of logistic regression by cross-validation on rows (features, y, w).

    Folds are cut by the rows' contents, so they are the same whatever the partitions.
    """
    lr = CLASSIFIERS["lr"]()
    grid = ParamGridBuilder().addGrid(lr.regParam, list(strengths)).build()
    scored = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MacroF1(), numFolds=folds, foldCol="fold").fit(rows.withColumn("fold", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(folds)).cast("int")))
    found = rows.sparkSession.createDataFrame([(float(s), float(m)) for s, m in zip(strengths, scored.avgMetrics, strict=True)], "strength double, macro_f1 double")  # a row for each setting
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("macro_f1"), "strength")))


class MacroF1(Evaluator):
    """Macro F1 from the counts of true and predicted labels."""

    def _evaluate(self, dataset: DataFrame) -> float:
        report = metrics.class_report(metrics.confusion(dataset, F.col("y"), F.col("prediction")))
        return float(report.agg(F.avg("f1").alias("m")).first().m or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def bagged(rows: DataFrame, key: str, classifier: str = "svm", count: int = 10, share: float = 0.8) -> list:
    """`count` models, each fitted on about `share` of rows (features, y, w), drawn by the MD5 of bag and key."""
    drawn = tasks.bags(rows, key, count, share)
    return [CLASSIFIERS[classifier]().fit(drawn.where(F.col("bag") == k)) for k in range(count)]


def hard_vote(fitted: list, rows: DataFrame, key: str) -> DataFrame:
    """(key, predicted, votes): the class that most models predict, the smaller of equally frequent ones."""
    votes = rows.select(key, "features", "w")
    for k, m in enumerate(fitted):
        votes = m.transform(votes).withColumn(f"v{k}", F.col("prediction").cast("int")).select(key, "features", "w", *(f"v{j}" for j in range(k + 1)))
    each = votes.select(key, F.explode(F.array(*(f"v{k}" for k in range(len(fitted))))).alias("v")).groupBy(key, "v").agg(F.count("*").alias("votes"))
    best = F.max_by(F.struct("v", "votes"), F.struct("votes", -F.col("v")))
    return each.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias("predicted"), F.col("b.votes").alias("votes"))


def learning_curve(train: DataFrame, held_out: DataFrame, iterations: tuple[int, ...] = (1, 2, 5, 10, 20, 50)) -> DataFrame:
    """(max_iter, accuracy, macro_f1, log_loss) on held_out of models refitted with ever more iterations."""
    out = None
    for n in iterations:
        done = CLASSIFIERS["lr"]().setMaxIter(n).fit(train).transform(held_out).withColumns({"k": F.lit(n), "p": F.element_at(vector_to_array("probability"), F.col("y").cast("int") + 1)})
        scores = metrics.summary(metrics.class_report(metrics.confusion(done, F.col("y"), F.col("prediction"), ["k"]), ["k"]), ["k"]).join(metrics.log_loss(done, "p", ["k"]).drop("n"), "k")
        one = scores.select(F.col("k").alias("max_iter"), "accuracy", "macro_f1", "log_loss")
        out = one if out is None else out.unionByName(one)
    return out


def stopped(curve: DataFrame, patience: int = 2) -> DataFrame:
    """The row of the curve at which training stops: the best macro F1 before `patience` rows without a better one."""
    w = Window.orderBy("max_iter")  # a row for each refit
    best = curve.withColumn("best", F.max("macro_f1").over(w)).withColumn("place", F.row_number().over(w))
    last = best.withColumn("at", F.max(F.when(F.col("macro_f1") == F.col("best"), F.col("place"))).over(w)).withColumn("waited", F.col("place") - F.col("at"))
    end = last.where(F.col("waited") <= patience).withColumn("open", F.max(F.when(F.col("waited") >= patience, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return end.where("coalesce(open, 0) = 0").orderBy(F.desc("macro_f1"), "max_iter").limit(1).drop("best", "place", "at", "waited", "open")


def top_features(model: PipelineModel, count: int = 20) -> DataFrame:
    """(label, rank, term, weight) of a fitted text pipeline: the terms that speak most for each label.

    With two labels the coefficients of the second speak for the first with the other sign. The vocabulary is bounded by
    the pipeline's features.
    """
    spark = SparkSession.active()
    words = [t for stage in model.stages if isinstance(stage, CountVectorizerModel) for t in stage.vocabulary]
    idf = next(s for s in model.stages if isinstance(s, IDFModel)).idf.toArray()
    matrix, labels = model.stages[-1].coefficientMatrix.toArray(), model.stages[0].labels
    rows = {labels[0]: -matrix[0], labels[1]: matrix[0]} if len(labels) == 2 else dict(zip(labels, matrix, strict=True))
    listed = [(label, words[k], float(w[k])) for label, w in rows.items() for k in (-(w * (idf > 0))).argsort(kind="stable")[:count]]
    ranked = Window.partitionBy("label").orderBy(F.desc("weight"), "term")
    return spark.createDataFrame(listed, "label string, term string, weight double").withColumn("rank", F.row_number().over(ranked)).select("label", "rank", "term", F.round("weight", 6).alias("weight"))


def reduced(rows: DataFrame, size: int, vector: str = "features", into: str = "reduced") -> tuple[DataFrame, list[float]]:
    """rows with their `size` principal components, and the shares of variance; the covariance has the width squared."""
    model = PCA(k=size, inputCol=vector, outputCol=into).fit(rows)
    return model.transform(rows), model.explainedVariance.toArray().tolist()


def sentence_scores(models: dict[str, PipelineModel], sentences: DataFrame, text: str = "sentence", keys: tuple[str, ...] = ("doc_id", "sentence_idx"), least: int = 4) -> DataFrame:
    """(keys, score, label by dimension): supervised evidence, the greatest confidence of any dimension's model.

    Sentences of fewer than `least` words stay with score 0. Models are pipelines on the column `text`.
    """
    out = sentences.select(*keys, F.col(text).alias("text"), F.lit(1.0).alias("w"))
    names = list(models)
    for name, m in models.items():
        done = m.transform(out)
        sure = F.array_max(vector_to_array("probability"))
        label = F.element_at(F.array(*map(F.lit, m.stages[0].labels)), F.col("prediction").cast("int") + 1)
        kept = [*keys, "text", "w", *(f"{p}_{n}" for n in names[: names.index(name)] for p in ("sure", "label"))]
        out = done.withColumns({f"sure_{name}": F.round(sure, 3), f"label_{name}": label}).select(*kept, f"sure_{name}", f"label_{name}")
    most = F.greatest(*(f"sure_{n}" for n in names)) if len(names) > 1 else F.col(f"sure_{names[0]}")
    return out.select(*keys, F.when(X.word_count("text") >= least, most).otherwise(0.0).alias("score"), *(f"label_{n}" for n in names))
