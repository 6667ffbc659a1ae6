"""Forms of raw corpora and results, with nulls, empty tables and missing sources."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import text as X
from loomtext.operators import corpora
from loomtext.sources import readers, sinks


def test_catalogue_leaves_out_what_is_missing_or_of_another_kind(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "x", "text": "one"}\n\nnot json\n{"text": "two", "metadata": {"lang": "en"}}\n')
    (tmp_path / "My notes.md").write_text("# Title\n\nbody")
    (tmp_path / "blank.txt").write_text("  \n")
    (tmp_path / "c.csv").write_text("a,b\n")
    paths = [str(tmp_path / n) for n in ("a.jsonl", "My notes.md", "blank.txt", "c.csv", "none.jsonl")]
    with pytest.warns(UserWarning, match="left out"):
        rows = {r.chunk_id: r.text for r in readers.catalogue(spark, paths).collect()}
    assert len(rows) == 3 and rows["x"] == "one" and rows["a_00004"] == "two" and "# Title\n\nbody" in rows.values()
    assert readers.catalogue(spark, []).count() == 0


def test_annotations_keep_those_of_known_speakers(spark):
    notes = spark.createDataFrame([("a", "d1", "O"), ("a", "d2", "C"), ("b", "d1", "E"), (None, "d1", "N")], "speaker string, dialogue_id string, trait string")
    told = spark.createDataFrame([("a", "d1", 1, "second"), ("a", "d1", 0, "first"), ("c", "d1", 0, None)], "speaker string, dialogue_id string, pos int, line string")
    got = {r.trait: r.turns for r in corpora.annotated_dialogues(notes, told).collect()}
    assert got == {"O": ["first", "second"], "C": []}
    assert corpora.annotated_dialogues(notes, told.limit(0)).count() == 0


def test_quotes_in_text_counts_null_and_empty_quotes_as_items(spark):
    quotes = spark.createDataFrame([("d", "s", "O", "b c"), ("d", "s", "O", ""), ("d", "s", "O", None), ("d", "x", "O", "b")], "dialogue_id string, speaker string, trait string, quote string")
    records = spark.createDataFrame([("d", "s", "a b c")], "dialogue_id string, speaker string, text string")
    assert corpora.quotes_in_text(quotes, records).first()[:] == ("O", 4, 2, 1)


def test_types_traits_and_priors(spark):
    df = spark.createDataFrame([("enfj", "o", ["x"], 60.0), ("EN", None, ["zeal", "calm"], None), (None, "other", None, 50.0)], "t string, trait string, s array<string>, v double")
    got = df.select(L.assembled_type(L.mbti_axes("t")).alias("a"), L.inferred_trait("trait", F.col("s")).alias("b"), L.prior_label({t: L.percent_level("v") for t in L.TRAITS}).alias("c")).collect()
    assert [r.a for r in got] == ["ENFJ", "INTP", "INTP"]
    assert [r.b for r in got] == ["O", "C", None]
    assert [r.c for r in got] == ["O:HIGH,C:HIGH,E:HIGH,A:HIGH,N:HIGH", None, "O:LOW,C:LOW,E:LOW,A:LOW,N:LOW"]


def test_integers_too_long_for_a_number_are_null(spark):
    df = spark.createDataFrame([("a 12, b 99999999999999999999",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(X.integers("t").alias("x")).collect()] == [[12, None], [], None]


def test_predictions_read_what_their_names_say(spark, tmp_path):
    rows = spark.createDataFrame([("1", "t", "A", "B", 0), ("2", None, "", "B", 0), ("3", "t", "A", None, 0)], "id string, text string, gold_label string, predicted_label string, extra int")
    sinks.prediction_file(rows, str(tmp_path), "tier1", "essays", "ocean_O_lr")
    got = readers.predictions(spark, f"{tmp_path}/*.jsonl").collect()
    assert [r.asDict() for r in got] == [{"method": "tier1_essays_ocean_O_lr", "tier": "tier1", "dataset": "essays", "trait": "O", "id": "1", "gold_label": "A", "predicted_label": "B"}]


def test_nested_documents_by_line(spark, tmp_path):
    docs = [{"a": {"dlg_num": 1, "dialogue": {"d": ["x", "y"]}}}, {"b": {"dlg_num": 1, "dialogue": {}}}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, docs)))
    assert [r[:] for r in readers.dialogues(spark, str(tmp_path / "d.json"), whole=False).orderBy("pos").collect()] == [("a", "d", 0, "x"), ("a", "d", 1, "y")]
