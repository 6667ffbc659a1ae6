"""The registered queries that run at the reference's sizes."""

import os
import tempfile

import pytest

from loomtext.operators import metrics, models
from loomtext.plans import catalogue
from tests.oracle import DATA

QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def long_texts(spark):
    """Three texts: 2,500 words of their own, 1,000 words, and null."""
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(1, " ".join(f"w{k:04d}." for k in range(2500))), (2, " ".join(f"w{k:04d}." for k in range(1000))), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(os.path.join(folder, "documents.parquet"))
    return folder, dict(rows)


def test_long_texts_are_kept(spark, long_texts):
    folder, text = long_texts
    got = {r.doc_id: r.prepared for r in QUERIES["text_prepared_whole"](spark, folder).collect()}
    assert got == {1: " ".join(text[1].split()[:2000]), 2: text[2], 3: None}
    got = {r.doc_id: r.kept for r in QUERIES["head_tail_whole"](spark, folder).collect()}
    w = text[2].split()
    assert got[2] == " ".join(w[:256] + w[-256:])


def test_whole_vocabulary(spark, long_texts):
    folder, text = long_texts
    got = {r.doc_id: r.ids.split(" ") for r in QUERIES["vocabulary_encoded_whole"](spark, folder).collect()}
    assert {len(v) for v in got.values()} == {512} and set(got[3]) == {"0"}
    assert got[1] == [str(k + 2) for k in range(512)] == got[2]  # words in both texts come first, in their order


def test_sizes_of_samples_and_features(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(metrics, "bootstrap", lambda p, key, value, n: seen.append(n))
    monkeypatch.setattr(metrics, "paired_bootstrap", lambda p, key, a, b, n: seen.append(n))
    QUERIES["bootstrap_interval_whole"](spark, DATA)
    QUERIES["paired_bootstrap_whole"](spark, DATA)
    assert seen == [1000, 10_000]
    monkeypatch.setattr(models.Pipeline, "fit", lambda pipeline, rows: seen.append([s.getVocabSize() for s in pipeline.getStages() if hasattr(s, "getVocabSize")]))
    monkeypatch.setattr(models, "predict_labels", lambda *_: 1 / 0)
    monkeypatch.setattr(models, "soft_vote", lambda *_: 1 / 0)
    for name in ("model_text_lr", "model_text_vote"):
        with pytest.raises(ZeroDivisionError):
            QUERIES[name](spark, DATA)
    assert seen[2:] == [[15_000, 15_000]] * 3


def test_windows_of_several_files_in_any_order(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    for day in (9, 2, 5):  # the newest rows first
        rows = [(k, f"2024-01-{day:02d} {k % 24:02d}:10:00", "view", float(k)) for k in range(48)]
        df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "CAST(ts AS timestamp) ts", "event_type", "value")
        df.coalesce(1).write.mode("append").parquet(str(folder))
    got = QUERIES["stream_windows"](spark, str(tmp_path)).collect()
    assert len(got) == 72 and sum(r.n for r in got) == 144


def test_step_blocks_of_the_knowledge_base(spark, tmp_path):
    rows = [("a", "## INPUT\nx\n## STEP 1\ny\n## STEP 2\nz\n## STEP 3\nw"), ("b", "plain"), ("c", None)]
    spark.createDataFrame(rows, "chunk_id string, text string").write.parquet(str(tmp_path / "kb_chunks.parquet"))
    got = sorted((r.chunk_id, r.block, r.text) for r in QUERIES["kb_step_blocks"](spark, str(tmp_path)).collect())
    assert got == [("a", 0, "## INPUT\nx\n## STEP 1\ny"), ("a", 1, "## STEP 2\nz"), ("a", 2, "## STEP 3\nw"), ("b", 0, "plain")]
