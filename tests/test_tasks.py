import json
import math

import pytest
from pyspark.sql import functions as F

from loomtext.functions import replies
from loomtext.operators import knowledge, metrics, retrieval, tasks


def test_names_of_tasks():
    assert tasks.task_names("mbti_augmented", "4dim") == ["IE", "SN", "TF", "JP"]
    assert tasks.task_names("essays_uncleaned", "all") == tasks.task_names("essays", "ocean_binary") == [f"ocean_{t}" for t in "OCEAN"[:1] + "CEAN"]
    assert tasks.task_names("pandora", "SN") == ["SN"]
    for dataset, task in (("mbti", "ocean_binary"), ("essays", "4dim"), ("mbti", "nothing")):
        with pytest.raises(ValueError):
            tasks.task_names(dataset, task)


def test_task_rows_of_odd_records(spark):
    rows = [(1, "a", "intp"), (2, " ", "INTP"), (3, None, "INTP"), (4, "a", None), (5, "a", "XXXX"), (1, "a", "intp")]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    got = sorted(tuple(r) for r in tasks.type_rows(df, "id", "text", "label").collect())
    assert got == sorted(2 * [(1, "16class", "INTP"), (1, "IE", "I"), (1, "SN", "N"), (1, "TF", "T"), (1, "JP", "P")])
    assert tasks.type_rows(df.limit(0), "id", "text", "label").count() == 0


def test_labels_of_speakers(spark):
    rows = [("d", "A", t, "high", [1]) for t in "OCEAN"] + [("d", "A", "O", "low", [2]), ("d", "B", "O", "??", None), (None, None, None, None, None)]
    e = spark.createDataFrame(rows, "dialogue_id string, speaker string, trait string, level_raw string, utt_ids array<int>")
    got = {(r.dialogue_id, r.speaker): (r.O, r.C, r.signature, r.complete) for r in tasks.speaker_labels(e).collect()}
    assert got == {("d", "A"): ("HIGH", "HIGH", "HIGH|HIGH|HIGH|HIGH|HIGH", True), ("d", "B"): ("UNKNOWN", "UNKNOWN", None, False), (None, None): ("UNKNOWN", "UNKNOWN", None, False)}
    assert [tuple(r) for r in tasks.disagreement(e).where("trait = 'O'").collect()] == [("O", 2, 1, 0.5)]


def test_worked_examples_know_nothing_of_held_out_dialogues(spark):
    rows = [("train", "A", "O", "high", "kept quote"), ("train", "A", "O", "high", "seen elsewhere"), ("test", "B", "C", "low", " seen elsewhere "), ("train", "A", "N", "unclear", "not sure"), ("train", "A", None, "low", "x"), ("train", "A", "E", "low", None)]
    e = spark.createDataFrame(rows, "dialogue_id string, speaker string, trait string, level_raw string, nat_lang string")
    got = {(r.trait, r.pole, r.mapping): r.text for r in tasks.mapping_chunks(e, F.col("dialogue_id") == "test", 5).collect()}
    assert set(got) == {("O", "HIGH", "evidence_mapping"), ("N", "BOTH", "insufficient_evidence")} and "kept quote" in got["O", "HIGH", "evidence_mapping"] and "abstain" in got["N", "BOTH", "insufficient_evidence"]


def test_suffixes_of_splits(spark):
    df = spark.createDataFrame([("pandora_train",), ("a_b_eval",), ("plain",), (None,)], "s string")
    got = {r.s: (r.x.base, r.x.split) for r in df.select("s", tasks.split_suffix("s").alias("x")).collect()}
    assert got == {"pandora_train": ("pandora", "train"), "a_b_eval": ("a_b", "eval"), "plain": ("plain", "test"), None: (None, "test")}


def test_strings_at_any_depth(spark):
    deep = {"a": "x", "b": [{"c": ["y", 1, None, {"d": {"e": "z"}}]}], "f": 2.5}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, "not json"), (3, None), (4, '"s"')], "i int, j string")
    assert {r.i: r.s for r in df.select("i", replies.strings_of(F.col("j")).alias("s")).collect()} == {1: ["x", "y", "z"], 2: None, 3: None, 4: ["s"]}


def test_settings_of_categories(spark):
    words = lambda n: "\n\n".join(" ".join(f"w{k}_{j}" for j in range(40)) for k in range(n // 40))
    rows = [("a", words(120), "other"), ("b", words(240), "other"), ("c", words(320), "few_shot_example"), ("d", words(360), "few_shot_example"), ("e", None, "other"), ("f", "", None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, category string")
    got = {}
    for r in knowledge.chunked_by_category(df).collect():
        got.setdefault(r.chunk_id.split("_c")[0], []).append(len(r.text.split()))
    assert got["a"] == [120] and got["c"] == [320] and len(got["b"]) == 2 and len(got["d"]) == 2 and got["f"] == [0] and "e" not in got
    assert len(knowledge.chunked_by_category(df, legacy=(80, 0)).where("chunk_id LIKE 'a%'").collect()) == 2


def test_markdown_files(spark):
    df = spark.createDataFrame([("/x/My Notes.md", "# T\n\nbody"), ("/x/empty.txt", " ")], "path string, text string")
    assert [(r.chunk_id, r.category) for r in knowledge.markdown_chunks(df, "state_definition").collect()] == [("My-Notes", "state_definition")]


CHUNKS = [("a", "red river stone", "ocean", "state_definition"), ("b", "red river", "mbti", "state_definition"), ("c", "red stone", "both", "trait_definition"), ("d", None, "ocean", None), ("e", "", None, "state_definition")]


def test_filters_of_searches(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string, framework string, category string")
    asked = spark.createDataFrame([(1, "red river"), (2, None), (3, "")], "query_id long, query string")
    hits = lambda *a, **k: {(r.query_id, r.chunk_id) for r in retrieval.search(chunks, asked, *a, **k).collect()}
    assert hits("keyword", 5) == {(1, "a"), (1, "b"), (1, "c")}
    assert hits("keyword", 5, "ocean") == hits("semantic", 5, "ocean") == {(1, "a"), (1, "c")}
    assert hits("hybrid", 5, "both", ("state_definition",)) == {(1, "a"), (1, "b")} and hits("hybrid", 1, "mbti", "state_definition") == {(1, "b")}
    assert hits("none", 5) == set()
    with pytest.raises(ValueError):
        hits("other", 5)


def test_grid_of_vectors_finds_the_same_whatever_the_blocks(spark):
    from loomtext.operators.vectors import blockwise_top_k

    rows = [(k, [math.sin(k * 7 + j) for j in range(5)]) for k in range(120)] + [(500, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    best = lambda block: {(r.query_id, r.vec_id, r.rank) for r in retrieval.top_k(blockwise_top_k(v, q, 4, "cosine", block), 4, "query_id", "vec_id").collect()}
    assert best(1000) == best(7) and len(best(7)) == 160


def test_mcnemar_of_many_pairs(spark):
    df = spark.range(1).select(F.explode(F.array_repeat(F.lit(1), 10)).alias("x")).crossJoin(spark.range(30_000))
    rows = df.select(F.lit(1).alias("y"), F.when(F.col("id") % 1000 < 504, 1).otherwise(0).alias("a"), F.when(F.col("id") % 1000 < 504, 0).otherwise(1).alias("b"))
    (r,) = metrics.mcnemar(rows, F.col("y"), F.col("a"), F.col("b")).collect()
    z = (abs(r.only_a - r.only_b) - 1) / math.sqrt(r.only_a + r.only_b)
    assert r.only_a + r.only_b == 300_000 and r.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-5)


def test_places_in_groups_that_are_hot(spark):
    a = spark.createDataFrame([("g", k) for k in range(0, 400, 2)] + [("h", 9), (None, 1)], "g string, i long")
    b = spark.createDataFrame([("g", k * k) for k in range(150)] + [("h", 4), ("h", 5)], "g string, i long")
    got = sorted((r.g, r.place, r.i, r.other) for r in metrics.by_position(a, b, "g", "i").collect())
    assert got == [("g", k + 1, 2 * k, k * k) for k in range(150)] + [("h", 1, 9, 4)]
