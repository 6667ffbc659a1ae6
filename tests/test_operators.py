import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from loomtext.operators import augment, chain, containment, corpora, evidence, features, knowledge, metrics, models, profile, retrieval, sampling
from loomtext.session import table, written
from loomtext.sources import readers, sinks
from tests.oracle import DATA


def test_unified_forum_records(spark):
    rows = [(1, "INTP", "'" + "word " * 12 + "|||short'"), (2, "bad", "'" + "word " * 12 + "'"), (3, "ENFJ", "'tiny'"), (4, None, None)]
    got = corpora.forum_records(spark.createDataFrame(rows, "row_id long, mbti_type string, posts string")).collect()
    assert [(r.row_id, r.label_mbti, r.n_posts) for r in got] == [(1, "INTP", 1)]


def test_redelivered_comments(spark):
    rows = [(1, "a", "old", "en", "s", 1, 1), (1, "a", "new", "en", "s", 1, 2), (1, "a", "new", "en", "s", 1, 2), (None, "a", "x", "en", "s", 1, 1)]
    df = spark.createDataFrame(rows, "comment_id long, author string, body string, lang string, subreddit string, created_at int, ingested_at int")
    assert [(r.comment_id, r.body) for r in corpora.latest_comments(df).collect()] == [(1, "new")]


def test_quotes_fall_back_to_any_speaker(spark):
    turns = spark.createDataFrame([("d", "A", 1, "Utterance 1 A said: hello"), ("d", "B", 2, "bye"), ("d", "B", 2, "bye"), ("d", None, 3, None)], "dialogue_id string, speaker string, utt_id int, utterance string")
    e = spark.createDataFrame([("d", "A", "O", "high", [1, 2]), ("d", "A", "C", "low", [2]), ("d", "A", "E", None, [9]), ("x", "A", "N", "高", None)], "dialogue_id string, speaker string, trait string, level_raw string, utt_ids array<int>")
    got = {r.trait: (r.level, r.quote) for r in corpora.evidence_quotes(e, turns).collect()}
    assert got == {"O": ("HIGH", "hello"), "C": ("LOW", "bye"), "E": ("UNKNOWN", None), "N": ("HIGH", None)}


def test_split_shares_and_skew(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "rare").when(F.col("id") % 3 == 1, None).otherwise("hot").alias("s"))
    got = {(r.s, r.part): r["count"] for r in sampling.stratified_split(df, F.col("id"), F.col("s")).groupBy("s", "part").count().collect()}
    assert all(got[s, "train"] == 700 and got[s, "val"] == 150 and got[s, "test"] == 150 for s in ("rare", None, "hot"))


def test_capped_sample(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "big").otherwise("small"))
    got = {r.g: r["count"] for r in sampling.capped_sample(df, ["g"], F.col("id"), 150).groupBy("g").count().collect()}
    assert got == {"big": 150, "small": 100}


def test_containment_against_loops(spark):
    rng = random.Random(1)
    words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(400)]
    texts = [(k, " ".join(words[k * 20 : k * 20 + 40])) for k in range(15)] + [(99, None), (98, "short")]
    strings = [(k, " ".join(words[k * 7 : k * 7 + 8])) for k in range(40)] + [(77, None), (78, "tiny")]
    got = containment.contained(spark.createDataFrame(strings, "s_id int, s string"), spark.createDataFrame(texts, "t_id int, t string"), "s_id", "s", "t_id", "t")
    want = {(i, j) for i, s in strings for j, t in texts if s and t and len(s) >= 30 and s in t}
    assert {(r.s_id, r.t_id) for r in got.collect()} == want and want


def plain_chunks(text, size, overlap, least):
    chunks, now, n = [], "", 0
    for para in text.split("\n\n"):
        k = len(para.split())
        if n + k > size and now:
            if len(now.split()) >= least:
                chunks.append(now.strip())
            w = now.split()
            back = overlap * len(w) // size
            now = (" ".join(w[-back:]) + " " if back else "") + para
            n = len(now.split())
        else:
            now += ("\n\n" if now else "") + para
            n += k
    return chunks + ([now.strip()] if now and len(now.split()) >= least else [])


@pytest.mark.parametrize(("size", "overlap", "least"), [(10, 0, 1), (10, 3, 2), (4, 4, 1)])
def test_chunks_against_a_loop(spark, size, overlap, least):
    rng = random.Random(size)
    texts = ["\n\n".join(" ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 8))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in knowledge.packed(df, F.col("t"), size, overlap, least, into="c").collect()}
    assert got == {i: plain_chunks(t, size, overlap, least) for i, t in enumerate(texts)}


def test_chunk_ids_and_blocks(spark):
    df = spark.createDataFrame([("a", "one two\n\nthree four"), ("b", "one"), ("c", None), ("d", "")], "chunk_id string, text string")
    assert sorted((r.chunk_id, r.subchunk_index) for r in knowledge.chunked(df, 2).collect()) == [("a_c0", 0), ("a_c1", 1), ("b", None)]
    text = "## INPUT\nx\n## STEP 1\ny\n## STEP 2\nz\n## STEP 3\nw"
    blocks = spark.createDataFrame([(text,)], "t string").select(knowledge.step_blocks(F.col("t")).alias("b")).first().b
    assert [b.split("\n")[0] for b in blocks] == ["## INPUT", "## STEP 2", "## STEP 3"]


def test_validation(spark):
    from loomtext.functions.labels import validation_errors

    rows = [("c", "t", "ocean", "behavioral_marker", "s", "en", "A", None, None), ("c", " ", "mbti", "odd", "s", "en", "Z", "O", "UP"), ("c", "t", "ocean", "few_shot_example", "s", "en", "A", None, "HIGH")]
    names = ["chunk_id", "text", "framework", "category", "source_id", "lang", "tier", "trait", "pole"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = [r.e for r in df.select(validation_errors({n: F.col(n) for n in names}).alias("e")).collect()]
    assert got == [["ocean chunk missing valid trait"], ["missing text", "invalid category: odd", "invalid quality_tier: Z", "invalid pole: UP"], []]


def test_bm25_against_formula(spark):
    docs = [("a", "cat sat mat"), ("b", "cat cat dog"), ("c", "bird"), ("d", None), ("e", "")]
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(spark.createDataFrame(docs, "chunk_id string, text string"), spark.createDataFrame([(1, "dog mat"), (2, None), (3, "absent")], "query_id long, query string")).collect()}
    tokens = {k: t.split() for k, t in docs if t is not None}
    avg = sum(map(len, tokens.values())) / len(tokens)
    idf = math.log(len(tokens) - 1 + 0.5) - math.log(1.5)
    want = {k: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(tokens[k]) / avg)) for k in ("a", "b")}
    assert {k[1]: pytest.approx(v) for k, v in got.items()} == want and {k[0] for k in got} == {1}


def test_dense_search_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)] + [(300, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.dense(v, q, 5).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for i in range(0, 300, 50):
        want = sorted(range(300), key=lambda j: -cos(rows[i][1], rows[j][1]))[:5]
        assert [got[i, r] for r in range(1, 6)] == want


def test_metrics_of_equal_and_disjoint_labels(spark):
    run = lambda rows: metrics.summary(metrics.class_report(metrics.confusion(spark.createDataFrame(rows, "y string, p string"), F.col("y"), F.col("p")))).first()
    same = run([("INTP", "INTP"), ("INFJ", "INFJ"), ("ENFP", "ENFP"), (None, "X")])
    assert same.accuracy == same.macro_f1 == same.kappa == 1.0 and same.n == 3
    assert run([("A", "B"), ("B", "A")]).accuracy == 0.0


def test_mcnemar_and_bootstrap(spark):
    df = spark.createDataFrame([(k, "A", "A" if k < 12 else "B", "A" if k < 2 or k > 17 else "B") for k in range(20)], "i int, y string, a string, b string")
    r = metrics.mcnemar(df, F.col("y"), F.col("a"), F.col("b")).first()
    n, m = r.only_a + r.only_b, min(r.only_a, r.only_b)
    assert r.p == pytest.approx(min(1, 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2**n), abs=1e-6)
    assert metrics.mcnemar(df, F.col("y"), F.col("a"), F.col("a")).first().p == 1.0
    ci = metrics.bootstrap(df, F.col("i"), (F.col("a") == "A").cast("int"), 200).first()
    assert ci.lower <= 0.6 <= ci.upper and ci.n == 20
    assert metrics.paired_bootstrap(df, F.col("i"), F.lit(1.0), F.lit(1.0), 50).first().delta == 0.0


def test_wilcoxon_against_ranks(spark):
    rng = random.Random(5)
    rows = [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(200)] + [(None, 1.0)]
    r = metrics.wilcoxon(spark.createDataFrame(rows, "a double, b double"), F.col("a"), F.col("b")).first()
    d = [a - b for a, b in rows if a is not None and a != b]
    order = sorted(abs(x) for x in d)
    rank = lambda x: order.index(x) + (order.count(x) + 1) / 2
    assert r.n == len(d) and r.w_plus == pytest.approx(sum(rank(x) for x in d if x > 0))


def test_agreement(spark):
    same = [("a", 1), ("a", 1), ("b", 2), ("b", 2), ("c", 0), ("c", 0)]
    assert metrics.krippendorff_ordinal(spark.createDataFrame(same, "i string, r int"), "i", "r").first().alpha == 1.0
    apart = [("a", 0), ("a", 2), ("b", 2), ("b", 0)]
    assert metrics.krippendorff_ordinal(spark.createDataFrame(apart, "i string, r int"), "i", "r").first().alpha < 0


def test_evidence_order_and_blend(spark):
    df = spark.createDataFrame([(1, "Nothing at all here. I feel love. I feel hate."), (2, None), (3, "")], "doc_id long, text string")
    top = evidence.top_sentences(evidence.scored_sentences(df), 2).orderBy("rank").collect()
    assert [r.sentence_idx for r in top] == [1, 2]


def test_chain(spark):
    df = spark.createDataFrame([(1, "People felt curious about parties. The rest is silent."), (2, "zzz"), (3, None), (4, "")], "doc_id long, text string")
    staged = chain.states(chain.read_evidence(chain.rule_evidence(df, ("people", "curious"))))
    got = {r.doc_id: (r.n_evidence, r.predicted) for r in chain.predict(df, staged).collect()}
    assert got[1] == (1, "O:HIGH,C:LOW,E:HIGH,A:LOW,N:LOW") and got[2] == got[3] == got[4] == (0, "UNKNOWN")
    assert {r.predicted for r in chain.predict(df, staged, F.lit("PRIOR")).where("doc_id > 1").collect()} == {"PRIOR"}


class Flaky:
    def generate(self, prompts):
        if any(p == "fail" for p in prompts):
            raise ValueError("no answer")
        return [p.upper() for p in prompts]


def test_client_answers_and_failures(spark):
    rows = lambda *p: spark.createDataFrame([(x,) for x in p], "p string").coalesce(1).select(chain.client_answers(Flaky(), F.col("p"), 1).alias("a")).collect()
    assert [r.a for r in rows("a", "b")] == ["A", "B"] and [r.a for r in rows("fail")] == [None]


def test_augmentation_is_stable(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x"), (3, None)], "doc_id long, text string")
    one, two = (sorted(map(tuple, augment.augmented(df, 2, 0.3).collect()), key=str) for _ in range(2))
    assert one == two and len(one) == 3 + 4


def test_every_copy_has_its_changes(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(words[: 3 + k % 38]), "test" if k % 4 == 0 else "train") for k in range(80)] + [(99, None, "train")]
    df = spark.createDataFrame(rows, "doc_id long, text string, split string")
    got = {r.doc_id: r for r in augment.augmented(df, 2, 0.1, chosen=F.col("split") == "train").collect()}
    assert len(got) == 81 + 2 * 60 and not any(f"{k}_aug1" in got for k in range(0, 80, 4))
    kinds = set()
    for i, text, split in rows[:80]:
        for r in [got[f"{i}_aug{k}"] for k in (1, 2)] if split == "train" else []:
            old, new, n = text.split(), r.text.split(), max(1, int(0.1 * len(text.split())))
            kinds.add((len(new) > len(old)) - (len(new) < len(old)))
            assert len(new) - len(old) in (-n, 0, n) and set(new) <= set(old) and r.augmented
            if len(new) == len(old):
                assert sorted(new) == sorted(old) and (new != old if n == 1 else True)
    assert kinds == {-1, 0, 1}


def test_copies_of_a_long_text_take_steps_in_proportion(spark):
    text = " ".join(f"w{k}" for k in range(20_000))
    df = spark.createDataFrame([(k, text) for k in range(6)], "doc_id long, text string")
    began = time.perf_counter()
    sizes = {len(r.text.split()) for r in augment.augmented(df, 3).where("augmented").collect()}
    assert sizes == {18_000, 20_000, 22_000} and time.perf_counter() - began < 30


def test_copies_are_the_same_as_ever(spark):
    rows = [(1, "the cat sat on a mat by the door of our house"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "x y z"), (4, ""), (5, "of the")]
    got = {(r.doc_id, r.text) for r in augment.augmented(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.2).where("augmented").collect()}
    want = {
        ("1_aug1", "cat the door on a mat by the sat of our house"),
        ("1_aug2", "the cat sat on a mat by the door of cat our door house"),
        ("1_aug3", "the cat sat on a mat by door of our"),
        ("2_aug1", "gamma beta kappa delta epsilon zeta eta theta iota alpha"),
        ("2_aug2", "delta alpha beta kappa gamma delta epsilon zeta eta theta iota kappa"),
        ("2_aug3", "beta gamma delta epsilon zeta theta iota kappa"),
        *((f"4_aug{k}", "") for k in (1, 2, 3)),
        *(("5_aug1", "of"), ("5_aug2", "the of"), ("5_aug3", "of the")),
        *((None, "x y y z"), (None, "x z y"), (None, "x z")),
    }
    assert got == want


def test_terms_are_never_broadcast(spark):
    plan = features.tfidf(table(spark, DATA, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_profiles_of_empty_tables(spark):
    empty = spark.createDataFrame([], "text string, label_mbti string, n long")
    assert profile.leakage_stats(empty).first().n == 0
    assert profile.distribution(empty, F.col("label_mbti")).count() == 0
    assert profile.duplicates(empty, F.md5("text")).first().repeated == 0
    assert features.class_weights(empty, "label_mbti").count() == 0
    assert metrics.wilcoxon(empty.select(F.lit(1.0).alias("a"), F.lit(1.0).alias("b")), F.col("a"), F.col("b")).first().n is None


def test_dataset_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    assert profile.dataset_hash(a, ["i", "t"]).first() == profile.dataset_hash(a.orderBy(F.desc("i")), ["t", "i"]).first()
    assert profile.dataset_hash(a, ["i", "t"]).first() != profile.dataset_hash(a.limit(1), ["i", "t"]).first()


def test_text_model_learns(spark, tmp_path):
    rows = [(k, f"{'good fine nice' if k % 2 else 'bad poor sad'} word{k % 7}", "P" if k % 2 else "N") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = models.fit_text(df, "nb", "label", features=100, min_df=1, max_df=0.99)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert models.predict_labels(again, df).where("label <> predicted").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"id": "a", "text": "x"}\n\nnot json\n{"id": "b", "text": null}\n')
    (tmp_path / "val.jsonl").write_text('{"id": "c", "text": "y"}\n')
    (tmp_path / "test.jsonl").write_text("")
    got = {(r.id, r.split_file) for r in readers.splits(spark, str(tmp_path)).collect()}
    assert got == {("a", "train"), ("b", "train"), ("c", "val")}
    (tmp_path / "types.csv").write_text('type,posts\nINTP,"one ""q""\ntwo"\nENFJ,\n')
    assert [(r.mbti_type, r.posts) for r in readers.forum_types(spark, str(tmp_path / "types.csv")).collect()] == [("INTP", 'one "q"\ntwo'), ("ENFJ", None)]
    (tmp_path / "d.json").write_text(json.dumps({"Alex": {"dlg_num": 1, "dialogue": {"1": ["Utterance 1 Alex said: hi", "Utterance 2 Bo said: yo"]}}}))
    assert [r.line[-2:] for r in readers.dialogues(spark, str(tmp_path / "d.json")).orderBy("pos").collect()] == ["hi", "yo"]
    (tmp_path / "a.json").write_text(json.dumps({"Alex": {"annotation": {"1": {"O": {"level": "high", "utt_id": "1, 2", "nat_lang": "n"}}}}}))
    assert readers.annotations(spark, str(tmp_path / "a.json")).first().utt_ids == [1, 2]
    (tmp_path / "kb.jsonl").write_text('\n{"text": "t", "metadata": {"trait": "O"}}\n{"chunk_id": "z", "text": "u"}\n')
    assert [r.chunk_id for r in readers.kb_source(spark, str(tmp_path / "kb.jsonl"), "kb").orderBy("line").collect()] == ["kb_00002", "z"]
    (tmp_path / "v.txt").write_text("cat 1 2\ndog 3 4\n")
    assert readers.word_vectors(spark, str(tmp_path / "v.txt"), spark.createDataFrame([("dog",)], "word string")).first().vector == [3.0, 4.0]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "missing.jsonl"), readers.RECORD).count()


def test_resumed_append(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"))
    out = str(tmp_path / "out")
    rows.limit(4).write.json(out)
    sinks.append_missing(rows, written(spark.read.schema("id string").json(out)), "id", out)
    assert spark.read.schema("id string").json(out).distinct().count() == spark.read.json(out).count() == 10


def test_streaming_resumes(spark, tmp_path):
    from loomtext.streaming import running

    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    schema = "event_id long, event_type string, value double"
    seen = {}

    def keep(df, _):
        seen.update({r.event_type: r.n for r in df.collect()})

    for part in ([(1, "view", 1.0), (2, "error", 2.0)], [(3, "view", 5.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        running.run_to_end(running.running_counts(running.event_stream(spark, src, schema)), "update", state, keep)
    assert seen == {"view": 2, "error": 1}
