import pytest
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import replies
from loomtext.functions import text as X


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Check out http://example.com for details", "Check out for details"),
        ("As an INTJ, I think logically", "As an , I think logically"),
        ("hi @someone!!! so?!", "hi ! so!"),
        ("a|||b   c", "a b c"),
        ("ｆｕｌｌ", "full"),
        ("", ""),
        (None, None),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, text, X.clean) == want


def test_words(spark):
    assert one(spark, "hello world foo", X.word_count) == 3
    assert one(spark, "", X.word_count) == 0
    assert one(spark, "a b c d", lambda c: X.truncate_words(c, 2)) == "a b"
    assert one(spark, "a  b", lambda c: X.truncate_words(c, 2)) == "a  b"
    assert one(spark, "One. Two!  Three", X.sentences) == ["One.", "Two!", "Three"]
    assert one(spark, "1 2 3 4 5", lambda c: F.array_join(X.head_tail(X.words(c), 3), " ")) == "1 4 5"


def test_forum_text(spark):
    assert one(spark, "> quoted\n# Head [link](http://x) rest", X.forum_clean) == "Head link rest"
    assert one(spark, "Beep, I am a BOT", X.is_bot) is True
    assert one(spark, "x" * 5, lambda c: X.excerpt(c, 3)) == "xxx…"


def test_long_text(spark):
    assert one(spark, "word " * 200_000, X.word_count) == 200_000


def test_keyword_score(spark):
    assert one(spark, "I feel happy with people", X.keyword_score) == 1.0
    assert one(spark, "nothing here at all today", X.keyword_score) == 0.0


def test_containment(spark):
    df = spark.createDataFrame([("the cat", "See THE CAT run"), ("", "x"), ("a b c d", "d c b z"), (None, "x")], "q string, t string")
    assert [r.v for r in df.select(X.contains_fuzzily("q", "t").alias("v")).collect()][:3] == [True, False, False]
    ratio = [r.v for r in spark.createDataFrame([("kitten", "my kitten"), ("kitten", "my kitchen"), (None, "x")], "q string, t string").select(X.partial_ratio("q", "t").alias("v")).collect()]
    assert ratio[0] == 1.0 and 0.6 < ratio[1] < 1 and ratio[2] is None


@pytest.mark.parametrize(("raw", "want"), [("intp", "INTP"), (" ENFJ ", "ENFJ"), ("INVALID", None), (None, None)])
def test_mbti(spark, raw, want):
    assert one(spark, raw, L.mbti) == want


def test_labels(spark):
    assert one(spark, "INTP", L.mbti_axes) == {"IE": "I", "SN": "N", "TF": "T", "JP": "P"}
    assert one(spark, "INVALID", L.mbti_axes) == {}
    assert [one(spark, v, L.yes_no_level) for v in ("y", "n", "Y", None)] == ["HIGH", "LOW", "HIGH", "LOW"]
    assert [one(spark, v, L.percent_level, "double") for v in (50.0, 50.1, None)] == ["LOW", "HIGH", None]
    assert [one(spark, v, L.level) for v in ("High", "低", "undetermined", None)] == ["HIGH", "LOW", "UNKNOWN", "UNKNOWN"]
    assert [one(spark, v, L.pole) for v in ("+", "l", "neutral", "odd", None)] == ["HIGH", "LOW", "BOTH", "ODD", None]
    assert one(spark, "O:HIGH, c:low,bad", L.parse_trait_string) == {"O": "HIGH", "C": "LOW"}


@pytest.mark.parametrize(
    ("reply", "want"),
    [('```json\n[{"k": 1}]\n```', [1]), ('text [{"k": 1}, {"k": 2}] more', [1, 2]), ('cut [{"k": 3}, {"k": ', [3]), ("nothing", []), ("[]", []), (None, [])],
)
def test_salvage(spark, reply, want):
    df = replies.salvaged(spark.createDataFrame([(reply,)], "t string"), "t", "struct<k:bigint>", "found")
    assert [r.k for r in df.first().found] == want
