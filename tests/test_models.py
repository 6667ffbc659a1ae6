import pytest

from loomtext.operators import models


class Constant:
    """A model that predicts one class."""

    def __init__(self, k):
        self.k = k

    def transform(self, df):
        from pyspark.sql import functions as F

        return df.withColumn("prediction", F.lit(float(self.k)))


def test_votes(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0)], "id int, features int, w double")
    got = lambda *ks: {tuple(r) for r in models.hard_vote([Constant(k) for k in ks], rows, "id").collect()}
    assert got(2, 1, 2) == {(1, 2, 2), (2, 2, 2)} and got(3, 1) == {(1, 1, 1), (2, 1, 1)}


@pytest.mark.parametrize(("scores", "at"), [([0.5, 0.4, 0.3, 0.9], 1), ([0.1, 0.2, 0.2, 0.3, 0.2, 0.2, 0.9], 4), ([0.1, 0.2], 2), ([0.3, 0.3], 1)])
def test_training_stops_after_rounds_without_gain(spark, scores, at):
    curve = spark.createDataFrame([(k + 1, s, s) for k, s in enumerate(scores)], "max_iter int, macro_f1 double, accuracy double")
    assert [r.max_iter for r in models.stopped(curve).collect()] == [at]


def test_features_and_sentences(spark):
    rows = [("sun warm beach light", "a"), ("snow cold ice dark", "b")] * 12
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id int, text string, label string")
    fitted = models.fit_text(df, "lr", "label", min_df=1, max_df=0.99)
    best = {r.label: r.term for r in models.top_features(fitted, 1).collect()}
    assert best["a"] in "sun warm beach light" and best["b"] in "snow cold ice dark"
    s = spark.createDataFrame([(1, 0, "sun and warm beach"), (1, 1, "cold snow"), (2, 0, None)], "doc_id int, sentence_idx int, sentence string").where("sentence IS NOT NULL")
    got = {(r.doc_id, r.sentence_idx): (r.score, r.label_x) for r in models.sentence_scores({"x": fitted}, s).collect()}
    assert got[1, 0][0] > 0.5 and got[1, 0][1] == "a" and got[1, 1] == (0.0, "b")
