import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import copies, garble, language, neardup, overlap, pii, queries
from loomtext.llm.common import TOKEN
from tests.oracle import DATA, check

DOC = "doc_id long, text string, lang string, source string, domain_name string, split string"
WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("al", "en", "or", "ish", "une", "ack")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], DOC)


def texts(seed, n, length=80):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=length)) for _ in range(n)]


def edited(text, seed, changes):
    rng, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def grams(text, n):
    t = TOKEN.findall(text.lower())
    return {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}


def collection():
    base = texts(1, 60)
    rows = [(k, t, None, "s", None, "train" if k % 2 else "test") for k, t in enumerate(base)]
    rows += [(100 + k, edited(t, k, k % 14), None, "s", None, "val" if k % 2 else "Training") for k, t in enumerate(base)]
    rows += [(300 + k, base[0], None, "s", None, "train") for k in range(9)]
    return rows + [(400, None), (401, ""), (402, "short text"), (403, base[3].upper(), None, "s", None, None), (404, "ha " * 60), (405, "ha " * 60)]


def test_pairs_equal_brute_force(spark):
    rows = collection()
    own = {r[0]: grams(r[1], 3) for r in rows if r[1] and len(TOKEN.findall(r[1])) >= 40}
    want = {(i, j) for i in own for j in own if i < j and len(own[i] & own[j]) >= 0.5 * len(own[i] | own[j])}
    got = {tuple(r) for r in neardup.near_duplicate_pairs(docs(spark, rows + rows[:3]), 3, 0.5, 40).collect()}
    # a pair on the threshold is a candidate with probability 0.983 or more
    assert got <= want and len(got) >= 0.99 * len(want)
    without = docs(spark, [(0, "x")])
    assert all(0 not in p for p in map(tuple, neardup.near_duplicate_pairs(docs(spark, rows), 3, 0.5, 40, without).collect()))


def test_groups_are_connected_components(spark):
    rows = collection()
    pairs = [tuple(r) for r in neardup.near_duplicate_pairs(docs(spark, rows), 3, 0.5, 40).collect()]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(b)] = find(a)
    want = {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    got = {}
    for r in neardup.near_duplicate_groups(docs(spark, rows), 3, 0.5, 40).collect():
        got.setdefault(r.group_id, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in copies.components(edges).collect()}
    assert {got[k] for k in range(41)} == {0} and got[101] == 100


def test_large_groups_of_copies_are_linked_through_one(spark):
    members = spark.createDataFrame([(1, k, 50) for k in range(1, 51)] + [(90, k, 50) for k in range(90, 140)], "rep long, doc_id long, copies long")
    pairs = spark.createDataFrame([(1, 90)], "a long, b long")
    assert copies.expand(pairs, members, 2500).count() == 2500
    star = {tuple(r) for r in copies.expand(pairs, members, 2499).collect()}
    assert len(star) == 99 and all(x == 1 or y == 90 for x, y in star)


def test_estimate_of_registers():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
    r = neardup.registers(np.concatenate([a, b]), np.repeat([0, 1], 300), 2)
    n = np.array([300])
    assert neardup.estimated(r[:1], r[1:], n, n)[0] == pytest.approx(0.5, abs=0.1)
    assert neardup.compress(np.array([[1 << 63, 1 << 62, 0xFFFFFFFFFFFFFFFF]], np.uint64)).tolist() == [[0, 1 << 10, 0xFFFF]]


def test_overlaps_equal_brute_force(spark):
    rows = collection()
    side = {r[0]: {"train": "t", "training": "t", "val": "e", "test": "e"}.get((r[5] or "").lower()) if len(r) > 5 else None for r in rows}
    own = {r[0]: grams(r[1], 8) for r in rows if r[1] and len(TOKEN.findall(r[1])) >= 40}
    want = {(min(i, j), max(i, j)) for i in own for j in own if side[i] == "e" and side[j] == "t" and len(own[i] & own[j]) >= 0.5 * len(own[i])}
    found = overlap.overlapping_pairs(docs(spark, rows + rows[:2]))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 40
    report = overlap.overlap_report(docs(spark, rows), found).collect()
    assert {r.split for r in report} <= {"val", "test"} and sum(r.n_pairs for r in report) == len(want)


def test_suffixes_stand_in_order_of_their_contents():
    rng = np.random.default_rng(3)
    codes, ends = rng.integers(0, 3, 400).astype(np.uint16), np.array([7, 8, 150, 400])
    places, high, low = overlap.suffix_array(codes, ends, 8)
    end = {p: int(ends[np.searchsorted(ends, p, "right")]) for p in range(400)}
    want = sorted((p for p in range(400) if end[p] - p >= 8), key=lambda p: (codes[p : p + 8].tolist(), p))
    assert places.tolist() == want
    lcp = overlap.common_prefix(high, low)
    assert lcp[0] == 0
    for a, b, got in zip(want, want[1:], lcp[1:], strict=False):
        assert got == next((k for k in range(8) if codes[a + k] != codes[b + k]), 8)
    short, high, low = overlap.suffix_array(codes, ends, 3)
    assert len(short) == sum(end[p] - p >= 3 for p in range(400)) and (np.diff(high.astype(np.int64)) >= 0).all()


@pytest.mark.parametrize("hold", [1, 3, 1000])
@pytest.mark.parametrize("size", [1, 4, 50])
def test_adjacent_runs_in_batches_of_any_size(hold, size):
    import pyarrow as pa

    rng = random.Random(hold * 100 + size)
    rows = sorted(((h, 5, rng.random() < 0.6, k, k % 7, rng.randint(1, 3)) for k, h in enumerate(rng.choices(range(12), k=90))), key=lambda r: (r[0], r[1], not r[2]))
    names = ["high", "low", "train", "block", "place", "records"]
    table = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[a : a + size]]) for a in range(0, 90, size)]
    # with 12 codes of 16 bits in the last place the prefixes are alike but for the last token
    got = [tuple(r.values()) for b in overlap._adjacent(8, hold)(iter(table)) for r in b.to_pylist()]
    total = {h: sum(r[5] for r in rows if r[0] == h and r[2]) for h in range(12)}
    held = {r[0] for r in rows if not r[2]}
    assert sorted(g for g in got if not g[2]) == sorted((*r[:5], total[r[0]]) for r in rows if not r[2] and total[r[0]])
    train = [g[:5] for g in got if g[2]]
    want = [r[:5] for r in rows if r[2] and r[0] in held]
    assert len(train) == len(set(train)) and set(want) <= set(train) <= {r[:5] for r in rows if r[2]} and (hold < 1000 or set(train) == set(want))


def test_coverage_equals_brute_force(spark):
    rows = collection() + [(500, collection()[0][1] + " " + collection()[1][1], None, "s", None, "dev"), (501, "one two three", None, "s", None, "test")]
    side = {r[0]: {"train": "t", "training": "t", "val": "e", "test": "e", "dev": "e"}.get((r[5] or "").lower()) if len(r) > 5 else None for r in rows}
    words = {r[0]: TOKEN.findall(r[1].lower()) for r in rows if r[1] and len(TOKEN.findall(r[1])) >= 40}
    held = {g for i in words if side[i] == "t" for g in grams(" ".join(words[i]), 8)}
    want = set()
    for i, w in words.items():
        marks = [False] * len(w)
        for k in range(len(w) - 7):
            if side[i] == "e" and tuple(w[k : k + 8]) in held:
                marks[k : k + 8] = [True] * 8
        if any(marks):
            want.add((i, len(w), sum(marks), sum(b and not a for a, b in zip([False, *marks], marks, strict=False))))
    for size in (1, 500, overlap.BLOCK_TOKENS):
        overlap.blocks.__defaults__ = (overlap.SPAN, size)
        got = {tuple(r) for r in overlap.covered_records(docs(spark, rows)).select("doc_id", "n_tokens", "covered_tokens", "n_spans").collect()}
        assert got == want and len(want) > 20
    with pytest.raises(ValueError):
        overlap.covered_records(docs(spark, rows), 9)


def test_hot_bands_lose_no_pair(spark, monkeypatch):
    boiler = " ".join(WORDS[:30])
    rows = [(k, f"{boiler} {t}", None) for k, t in enumerate(texts(9, 40, 60))] + [(100 + k, f"{boiler} {edited(t, k, 4)}", None) for k, t in enumerate(texts(9, 40, 60))]
    rows += [(300 + k, " ".join([boiler, f"w{k}", f"v{k}"]), None) for k in range(12)]
    own = {r[0]: grams(r[1], 3) for r in rows if len(TOKEN.findall(r[1])) >= 20}
    want = {(i, j) for i in own for j in own if i < j and len(own[i] & own[j]) >= 0.5 * len(own[i] | own[j])}
    monkeypatch.setattr(neardup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(neardup.hot_bands, "__defaults__", (2,))
    monkeypatch.setattr(neardup.candidates, "__defaults__", (2,))
    got = {tuple(r) for r in neardup.near_duplicate_pairs(docs(spark, rows), 3, 0.5, 20).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_one_of_several_texts_of_an_id_counts_whatever_their_order(spark):
    a, b = texts(4, 2)
    rows = [(1, a, None, "s", None, "train"), (1, b, None, "s", None, "val"), (2, a, None, "s", None, "val"), (3, b, None, "s", None, "train")]
    for run in (neardup.near_duplicate_pairs, overlap.overlapping_pairs):
        got = {frozenset(map(tuple, run(docs(spark, r)).collect())) for r in (rows, rows[::-1], rows + rows, rows[1:] + rows[:1])}
        assert len(got) == 1


def test_report_counts_every_pair_of_large_classes(spark, monkeypatch):
    (text,) = texts(5, 1)
    rows = [(k, text, None, f"s{k % 2}", None, "val") for k in range(200)] + [(1000 + k, text, None, "t", None, "train") for k in range(100)]
    df = docs(spark, rows + rows[:5])
    links, members = overlap.overlapping_classes(df)
    assert {tuple(r) for r in overlap.class_report(df, links, members).collect()} == {("val", "s0", 100, 10_000), ("val", "s1", 100, 10_000)}
    classes = overlap.class_members(links, members)
    assert {(r.class_id, r.side, r.links, r["count"]) for r in classes.groupBy("class_id", "side", "links").count().collect()} == {(0, "held_out", 1, 200), (1000, "train", 1, 100)}
    # the registered query, too
    monkeypatch.setattr(queries, "table", lambda *_: df)
    monkeypatch.setattr(queries, "_garbled", lambda *_: None)
    assert sum(r.n_pairs for r in queries.p4_report(spark, "").collect()) == 20_000


def test_report_of_classes_equals_report_of_pairs(spark):
    df = docs(spark, collection())
    links, members = overlap.overlapping_classes(df)
    want = overlap.overlap_report(df, overlap.overlapping_pairs(df)).collect()
    assert {tuple(r) for r in overlap.class_report(df, links, members).collect()} == {tuple(r) for r in want}


@pytest.mark.parametrize("run", [lambda d: neardup.near_duplicate_pairs(d), lambda d: neardup.near_duplicate_groups(d), lambda d: overlap.overlapping_pairs(d), lambda d: pii.findings(d)])
def test_empty_tables(spark, run):
    assert run(docs(spark, [(1, "x")]).limit(0)).count() == 0
    assert run(docs(spark, [(1, None), (2, "")])).count() == 0


CLEAN = ["Für die Gäste räumen wir früh die Küche auf.", "La bibliothécaire était très fatiguée après la fête à l'école.", "Мой сосед всё ещё помнит этот спор на кухне.", "我的室友在厨房里忘掉了那场争吵。", "Plain words in a row, nothing odd about them."]


@pytest.fixture(scope="module")
def model(spark):
    import itertools

    rows = [(k, CLEAN[k % 5] + " " + c) for k, c in enumerate(itertools.islice(itertools.cycle(CLEAN), 400))]
    return garble.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_the_model_counts_every_document(spark):
    rows = spark.range(12_000).selectExpr("id AS doc_id", "concat('caf\u00e9 ', decode(unhex(hex(40960 + id)), 'UTF-16BE')) AS text")
    fitted = garble.fit(rows)
    assert (fitted.ids[40960 : 40960 + 12_000] > 0).all()


def test_counts_are_those_of_each_text():
    some = [*CLEAN, "caf\u00e9 caf\u00e9  na\u00efve", "\u4f60\u597d \u4e16\u754c", "plain text", " ", "\u043c\u0438\u0440 \u00e9", ""]
    got, want = {}, {}
    for state, before, code, n in garble.counts_of(some):
        for key in zip([state] * len(n), before.tolist(), code.tolist(), n.tolist(), strict=True):
            got[key[:3]] = got.get(key[:3], 0) + key[3]
    odd = [t for t in some if not t.isascii()]
    for group, times in ((some, garble.PLAIN), ([t.upper() for t in odd], garble.CAPITALS)):
        for text in filter(None, group):
            for state in range(garble.SUBSTITUTE):
                if garble.states_of([text])[0] >> state & 1:
                    codes = [10, *map(ord, garble.through(text, state)), 10]
                    folded = [0x4E00 if 0x4E00 <= c <= 0x9FFF else c for c in codes]
                    for key in [*zip(folded, folded[1:], strict=False), *((-1, c) for c in codes[1:])]:
                        want[state, *key] = want.get((state, *key), 0) + times
    assert {k: n for k, n in got.items() if n} == want


def test_garbled_texts_come_back(spark, model):
    cases = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437")]
    rows = [(10 * k + j, garble.garble(t, pair)) for k, t in enumerate(CLEAN[:2]) for j, pair in enumerate(cases)]
    twice = garble.garble(garble.garble(CLEAN[0], ("utf-8", "cp1252")), ("utf-8", "cp1252"))
    rows += [(50, garble.garble(CLEAN[2], ("koi8_r", "cp1251"))), (51, twice), (60, CLEAN[0]), (61, CLEAN[2]), (62, CLEAN[3]), (63, None), (64, ""), (67, "\ufffd"), (65, "what?really?yes"), (66, "lost � sign")]
    got = {r.doc_id: r for r in garble.repairs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, t in enumerate(CLEAN[:2]):
        assert all(got[10 * k + j].restored == t for j in range(4))
    assert got[50].restored == CLEAN[2] and got[51].restored == CLEAN[0] and got[66].errors == ["substitute"]
    assert got[67].errors == ["substitute"] and not set(got) & {60, 61, 62, 63, 64, 65}


def test_errors_are_undone_however_often_they_were_made(model, monkeypatch):
    text = CLEAN[0]
    for _ in range(7):
        text = garble.garble(text, ("utf-8", "latin-1"))
    # with a model that sees every trace of this error
    monkeypatch.setattr(garble, "label", lambda t, *_: np.full(len(t), 1 if "\xc3" in t else 0))
    monkeypatch.setattr(garble.Model, "clean_score", lambda _, before, t, after: -5.0 * len(t))
    assert garble.repair(text, model, {}) == (CLEAN[0], ["utf-8>latin-1"] * 7)


def test_substitute_signs_are_a_state_of_the_model(model):
    text = "pl\ufffdin w\ufffdrds"
    labels = garble.label(text, model, {})
    assert [k for k, s in enumerate(labels) if s == garble.SUBSTITUTE] == [2, 7] and set(labels) == {0, garble.SUBSTITUTE}
    assert garble.repair(text, model, {}) == (text, ["substitute"])
    # rare characters, each with its own id, are no errors
    assert garble.repair("ꙮ 𒀀 ᚠᚢᚦ ⠓⠑ \u200b fine", model, {})[1] == []


def test_lost_letters_come_from_the_corpus(spark, model):
    rows = [(k, CLEAN[0]) for k in range(5)] + [(9, "F?r die G?ste ist die K?che da.")]
    got = garble.repairs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.restored) for r in got] == [(9, "Für die Gäste ist die Küche da.")]


def test_findings(spark):
    people = ["Ana Welkes", "Ben Tarrow", "Cleo Dunmar", "Ana Dunmar", "Ben Welkes", "Cleo Tarrow"]
    rows = [(k, f"My name is {people[k % 6]}. Call me at 202-555-01{k:02d} today.") for k in range(60)]
    rows += [(100, "Then ben dunmar left. Mail ana.b@club.example now or ana (at) club (dot) example."), (101, "We live at 12 Oak Street near Ana. P.O. Box 77 is closed. version 10.2.12.4"), (102, None), (103, ""), (104, "nothing 3.14159265")]
    df = docs(spark, rows)
    text = dict(r[:2] for r in rows)
    got = {(r.doc_id, r.kind, text[r.doc_id][r.start_char : r.end_char]) for r in pii.findings(df).where("doc_id >= 100").collect()}
    assert got == {(100, "name", "ben dunmar"), (100, "email", "ana.b@club.example"), (100, "email", "ana (at) club (dot) example"), (101, "address", "12 Oak Street"), (101, "address", "P.O. Box 77")}
    found = pii.findings(df)
    clean = {r.doc_id: (r.n_found, r.clean_text) for r in pii.sanitised(df, found).collect()}
    assert clean[0] == (2, "My name is [NAME]. Call me at [PHONE] today.") and clean[102] == (0, None) and clean[103] == (0, "")


def test_every_kind_goes_through_the_disclosure_threshold(spark):
    fill = "the river was wide and the road was long and then it rained a lot "
    rows = [(k, f"Phone: +1 202 555 01{k:02d} {fill}") for k in range(60)]
    rows += [(100 + k, f"nobody beeped {'5550' if k % 2 else '+1 202 555 0'}{k:03d} {fill}") for k in range(40)] + [(200, "Phone: 5550999"), (201, "it was 5550998 long")]  # a word that becomes a cue, a doubtful shape
    rows += [(300 + k, f"my name is {('Ana', 'Ben')[k % 2]} {('Welkes', 'Tarrow', 'Dunmar')[k % 3]} {fill}") for k in range(30)]
    rows += [(450 + k, f"Thanks to Ms. Welkes {fill}") for k in range(5)]
    rows += [(500 + k, f"我叫王{c}。") for k, c in enumerate("伟芳娜敏静")] + [(510, "请联系王先生。"), (511, "请问这位先生。"), (512, "你说的那位先生在哪里")]
    # a form of addresses that never stands where addresses do
    rows += [(1000 + k, f"{fill * 30} {fill.split()[k % 15]} 12 Long Court {fill}") for k in range(300)] + [(2000, "mail me: a@b.example")]
    text = dict(r[:2] for r in rows)
    got = [(r.doc_id, r.kind, text[r.doc_id][r.start_char : r.end_char]) for r in pii.findings(docs(spark, [*rows, (1, None), (2, "")])).collect()]
    found = {g[0]: g for g in got}
    assert all(found[k][1] == "phone" for k in range(60)) and all(found[k][1:] == ("phone", f"5550{k - 100:03d}") for k in range(101, 140, 2)) and 201 not in found
    assert all(found[k][1:] == ("name", "Welkes") for k in range(450, 455))
    assert found[510] == (510, "name", "王") and not {511, 512} & set(found)
    assert not any(k >= 1000 and k < 2000 for k in found) and found[2000][1:] == ("email", "a@b.example")


def test_every_name_form():
    known = lambda w: w.lower() in {"ana"}
    got = {(g.lower(), f) for _, _, g, f in pii.name_pairs("Ana K. Tarrow, then Tarrow, Ana; and A. Tarrow. ana@x.example", known, lambda w: False)}
    assert ("ana", "Tarrow") in got and ("", "Tarrow") in got
    assert [f for _, _, f, _ in pii.titled_names("Thanks to Ms. Welkes and dr. Tarrow")] == ["Welkes", "Tarrow"]


EN = "the people near the river were talking about the long winter and the quiet market in town"
DE = "die Leute an dem Fluss sprachen lange über den Winter und den ruhigen Markt in der Stadt"
FR = "les gens près de la rivière parlaient du long hiver et du marché tranquille dans la ville"


def shuffled(text, seed):
    w = text.split()
    random.Random(seed).shuffle(w)
    return " ".join(w).capitalize() + "."


def test_languages(spark):
    rows = [(k, shuffled((EN, DE, FR)[k % 3], k), ("en", "German", "fra")[k % 3], "s", "d", None) for k in range(240)]
    rows += [(900, shuffled(EN, 7) + " " + shuffled(DE, 8), "en"), (901, shuffled(DE, 9), "English"), (902, shuffled(FR, 3), None), (903, shuffled(FR, 4), "??"), (904, None, "en"), (905, "", None), (906, "123 456", None), (907, shuffled(EN, 11) + " die Leute.", "EN-us")]
    codes = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French")], "code string, code3 string, english_name string")
    ident = language.identify(docs(spark, rows), codes).cache()
    assert {tuple(r) for r in language.label_cases(ident).where("doc_id >= 900").collect()} == {(900, "en"), (900, "de"), (901, "de"), (902, "fr"), (903, "fr")}
    held = ident.where("doc_id < 240").select("lang", (F.col("doc_id") % 3).alias("k"), "confidence").collect()
    assert sum(r.lang == ("en", "de", "fr")[r.k] for r in held) >= 238 and all(0 < r.confidence <= 1 for r in held)


class Fixed(language.TextModel):
    """Scores of tokens as given."""

    def __init__(self, given):
        self.given = given

    def scores(self, words):
        return np.array([self.given[w] for w in words], float)


def best_path(scores, prior, ends):
    """The score of the best path, from all paths."""
    import itertools

    cost = lambda p: sum((language.SWITCH_AT_END if ends[k] else language.SWITCH) for k in range(1, len(p)) if p[k] != p[k - 1])
    return max(np.log(prior[p[0]]) + sum(s[c] for s, c in zip(scores, p, strict=True)) - cost(p) for p in itertools.product(range(len(prior)), repeat=len(scores)))


def first_language(model, text, prior, label=None):
    passages, whole = model.passages(text, np.log(prior), None if label is None else np.log(label))
    assert len(passages) > 1 or passages[0][2] == int(whole.argmax())
    return passages[0][2]


def test_passages_fuse_tokens_prior_and_label():
    near = Fixed({"x": [0.0, -0.1]})  # ten tokens favour language 0 by 1 nat, tempered 0.5
    text = " ".join(["x"] * 10)
    flat = np.array([0.5, 0.5])
    assert first_language(near, text, flat) == 0
    assert first_language(near, text, np.array([0.1, 0.9])) == 1
    assert first_language(near, text, flat, np.array([0.1, 0.9])) == 1
    clear = Fixed({"x": [0.0, -5.0]})  # clear texts withstand both
    assert first_language(clear, text, np.array([0.01, 0.99]), np.array([0.1, 0.9])) == 0


def test_two_passages_that_pay_for_one_change_together():
    # against language 2 each half gains 5, below the cost of a change at a sentence's end, but both gain 10
    model = Fixed({"a": [0.0, -8.0, -2.5], "b": [-8.0, 0.0, -2.5]})
    got, _ = model.passages("a a. b b", np.log(np.full(3, 1 / 3)))
    assert [g[2] for g in got] == [0, 1]
    assert best_path(model.scores(list("aabb")), np.full(3, 1 / 3), [False, False, True, False]) == pytest.approx(np.log(1 / 3) - language.SWITCH_AT_END)


def test_host_label_and_suffix_decide_doubtful_texts(spark):
    rows = [(k, shuffled((EN, DE)[k % 2], k) + (" See www.x.aa now." if k % 2 else " See www.x.bb now."), ("en", "de")[k % 2], "s", ("north", "south")[k % 2]) for k in range(200)]
    doubt = "11 22 33 44 55 66 77 88"  # tokens that tell nothing
    rows += [(901, doubt, None, "s", "north"), (902, doubt, None, "s", "south"), (903, doubt, "en", "t", None), (904, doubt, "de", "t", None), (905, doubt + " www.y.aa", None, "t", None), (906, doubt + " www.y.bb", None, "t", None)]
    codes = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German")], "code string, code3 string, english_name string")
    got = {r.doc_id: (r.lang, [p.lang for p in r.passages]) for r in language.identify(docs(spark, rows), codes).where("doc_id > 900").collect()}
    assert got == {k: (c, [c]) for k, c in ((901, "en"), (902, "de"), (903, "en"), (904, "de"), (905, "de"), (906, "en"))}
    cases = language.label_cases(language.identify(docs(spark, rows), codes)).where("doc_id > 900").collect()
    assert {tuple(r) for r in cases} == {(901, "en"), (902, "de"), (905, "de"), (906, "en")}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql().get(name))


def test_columns_of_found(spark):
    want = {
        "p2_found": [("doc_id", "bigint"), ("kind", "string"), ("start_char", "int")],
        "p3_found": [("doc_a", "bigint"), ("doc_b", "bigint")],
        "p4_found": [("doc_a", "bigint"), ("doc_b", "bigint")],
        "p5_found": [("doc_id", "bigint"), ("lang", "string")],
        "p8_found": [("doc_id", "bigint")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, DATA).dtypes == columns


def test_nothing_outside_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any(re.search(r"loomtext\.llm|from \.+llm", p.read_text()) for p in others)


def test_hits_of_blocks_are_never_gathered_in_lists(spark):
    rows = [(k, t, None, "s", None, "train" if k % 2 else "test") for k, t in enumerate(texts(5, 6) * 2)]
    concatenated, _, _ = overlap._concatenated(docs(spark, rows), 8, 40, None)
    shared = overlap.shared_runs(concatenated)
    met = shared.where("train").select("block", "place")
    for df in (overlap.coverage(concatenated, shared, 0.5), overlap._holders(concatenated, met, 8)):
        assert "collect_list" not in df._jdf.queryExecution().toString()


def test_what_overlaps_leave_out_comes_from_all_documents(spark, tmp_path, monkeypatch):
    spark.range(12_000).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    seen, build = [], garble.build

    def watched(state, before, code, n):
        seen.append(n[(state == 0) & (before == -1) & (code == ord("x"))].sum() / getattr(garble, "PLAIN", 1))
        return build(state, before, code, n)

    monkeypatch.setattr(garble, "build", watched)
    queries._garbled(spark, str(tmp_path)).count()
    assert seen == [12_000]


def test_language_model_counts_all_documents(spark):
    labelled = spark.range(30_000).selectExpr("id AS doc_id", "concat('the people of the town ', id) AS text", "'en' AS code")
    assert language.TextModel(language.fit(labelled, ["en"])).total.tolist() == [6 * 30_000]


def test_rare_words_of_many_documents_keep_their_own_counts():
    assert len({language._features(f"name{k}x")[0] for k in range(100_000)}) > 99_000
