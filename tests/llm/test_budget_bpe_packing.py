import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import bpe, budget, packing

tokenizers = pytest.importorskip("tokenizers")
PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
CODES = [("en", "eng", "English"), ("de", "deu", "German"), (None, None, None)]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(PATH, "rb").read())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_ids_equal_the_public_encoder(reference, encoder, texts):
    clean = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [list(x) for x in encoder.encode(clean)] == [reference.encode(t, add_special_tokens=False).ids for t in clean]


def test_wide_pieces_equal_the_public_encoder(reference, encoder):
    texts = ["word" * 1500, "我们在图书馆里想起了那场争吵" * 60, "a" * 5000, "aab" * 700 + "é" * 900, " " * 3000 + "x", "!?" * 2000]
    assert [x.tolist() for x in encoder.encode(texts)] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts(spark, reference):
    texts = [None, "", " ", "<|endoftext|> [MASK]", "a" * 5000, "中文" * 900, "​\x00é퟿", "x y " * 20_000, "same", "same"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {k: [] if t is None else reference.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert bpe.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.sizes(df).collect()} == {k: len(v) for k, v in got.items()}


def greedy(words, raw):
    n = at = 0
    while at < len(raw):
        at += next(k for k in range(len(raw) - at, 0, -1) if raw[at : at + k] in words)
        n += 1
    return n


def test_longest_match_equals_greedy():
    rng = random.Random(1)
    words = {bytes([b]) for b in range(256)} | {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(60)}
    m = budget.LongestMatch(sorted(words))
    for _ in range(3000):
        raw = bytes(rng.choices(b"abcd", k=rng.randint(0, 30)))
        assert m.count(raw) == greedy(words, raw)


def test_estimate_is_close(reference):
    m = budget.matcher(open(PATH, "rb").read())
    text = "The librarian kept writing lists over the holidays. " * 20
    assert m.tokens(text) == pytest.approx(len(reference.encode(text).ids), rel=0.1) and m.tokens(None) == m.tokens("") == 0


def test_spellings_share_a_slice(spark):
    rows = [("a b", "pandora", "en", "r/Music"), ("a", " PANDORA", "English", "music "), (None, "Personality-Evd", "de-AT", None), ("", None, "??", " ")]
    df = spark.createDataFrame(rows, "text string, source string, lang string, domain_name string").withColumn("n_tokens", F.lit("clash"))
    codes = spark.createDataFrame(CODES, "code string, code3 string, english_name string")
    got = {(r.source, r.lang, r.domain): (r.n_docs, r.n_tokens) for r in budget.token_budget(df, codes).collect()}
    assert got == {("pandora", "en", "music"): (2, 3), ("personality_evd", "de", "unknown"): (1, 0), ("unknown", "unknown", "unknown"): (1, 0)}
    totals = budget.budget_totals(budget.token_budget(df, codes))
    assert totals.where("field = 'all'").first().n_docs == 4
    assert budget.token_budget(df.limit(0), codes).count() == 0


@pytest.mark.parametrize(("count", "windows"), [(1, 4), (40, 2), (8, 64)])
def test_packing_keeps_every_token(spark, count, windows):
    rng = random.Random(windows)
    items = [(k, rng.choice([0, 1, 5, 60, 99, 100, 101, 350])) for k in range(500)] + [(7, 60)]
    df = spark.createDataFrame([(1, 100, k, n) for k, n in items] + [(2, 64, k, n) for k, n in items], "spec_id int, capacity int, doc_id long, n_tokens int")
    rows = packing.pack(df, windows, count).collect()
    for spec, capacity in ((1, 100), (2, 64)):
        own = [r for r in rows if r.spec_id == spec]
        fill, parts, total = Counter(), Counter(), Counter()
        for r in own:
            fill[r.container_id] += r.n_tokens
            parts[r.doc_id] += 1
            total[r.doc_id] += r.n_tokens
        assert max(fill.values()) <= capacity
        want = Counter()
        for k, n in items:
            want[k] += n
        assert total == want and all(parts[k] == max(1, -(-n // capacity)) for k, n in items if k != 7)
        assert sum(fill.values()) / (len(fill) * capacity) > 0.8
    again = packing.pack(df, windows, count).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_packing_of_odd_specs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words here " * 50)], "doc_id long, text string")
    spec = lambda rows: spark.createDataFrame(rows, "spec_id int, tokenizer string, capacity int")
    rows = packing.pack_documents(docs, spec([(1, "byte_bpe_50k", 32)])).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and max(Counter(r.container_id for r in rows).values()) >= 1
    assert packing.pack_documents(docs, spec([])).count() == 0
    for bad in ([(1, "byte_bpe_50k", 0)], [(1, None, 5)]):
        with pytest.raises(ValueError):
            packing.pack_documents(docs, spec(bad))

