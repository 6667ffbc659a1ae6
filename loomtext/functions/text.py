"""Text functions as column expressions; all but nfkc and partial_ratio run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Patterns of what is cleaned away, and lists of words.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
URL = r"https?://[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|www\.[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
MENTION = r"@[\p{L}\p{N}_]+"
WORD = r"[\p{L}\p{N}_]+"
MBTI_TYPES = ("INFJ", "INFP", "INTJ", "INTP", "ISFJ", "ISFP", "ISTJ", "ISTP", "ENFJ", "ENFP", "ENTJ", "ENTP", "ESFJ", "ESFP", "ESTJ", "ESTP")
TYPE_MENTION = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(MBTI_TYPES) + r")(s|es)?(?![\p{L}\p{N}_])"
BOT_PHRASES = ("i am a bot", "automoderator", "this action was performed automatically")
LEXICON = {
    "social": ("friend", "people", "talk", "social", "group", "party", "together", "relationship", "interact"),
    "cognitive": ("think", "idea", "concept", "analyze", "understand", "theory", "logic", "reason", "plan"),
    "emotion": ("feel", "love", "hate", "sad", "happy", "angry", "anxious", "excited", "overwhelm", "worry"),
    "preference": ("prefer", "like", "enjoy", "love", "hate", "interest", "passion", "favorite", "avoid"),
    "lifestyle": ("always", "never", "routine", "schedule", "organize", "spontaneous", "flexible", "deadline"),
    "decision": ("decide", "choose", "weigh", "consider", "judge", "evaluate", "opt", "select", "pick"),
}
LEXICON_WORDS = tuple(sorted({w for words in LEXICON.values() for w in words}))

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_urls(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), URL, " ")


def remove_mentions(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), MENTION, " ")


def remove_type_mentions(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), TYPE_MENTION, "")


def remove_post_marks(c: ColumnOrName) -> Column:
    return F.replace(_c(c), F.lit("|||"), F.lit(" "))


def collapse_punctuation(c: ColumnOrName) -> Column:
    """A run of ! ? . becomes its last character."""
    return F.regexp_replace(_c(c), r"([!?.]){2,}", "$1")


def squeeze(c: ColumnOrName) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(c), WHITE + "+", " "), "^ | $", "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC normal form; Spark has no function for it."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def clean(c: ColumnOrName, lower: bool = False, normalize: bool = True) -> Column:
    """The cleaning order: URLs, mentions, post marks, type mentions, case, punctuation, normal form, white space."""
    x = remove_type_mentions(remove_post_marks(remove_mentions(remove_urls(c))))
    x = collapse_punctuation(F.lower(x) if lower else x)
    return squeeze(nfkc(x) if normalize else x)


def words(c: ColumnOrName) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_c(c), WHITE + "+"), lambda w: w != "")


def word_count(c: ColumnOrName) -> Column:
    return F.size(words(c)).cast("bigint")


def truncate_words(c: ColumnOrName, n: int) -> Column:
    """The first n words; shorter texts stay as they are."""
    return F.when(F.size(words(c)) > n, F.array_join(F.slice(words(c), 1, n), " ")).otherwise(_c(c))


def tokens(c: ColumnOrName) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD), F.lit(0))


def sentences(c: ColumnOrName) -> Column:
    parts = F.split(_c(c), r"(?<=[.!?])" + WHITE + "+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, f"^{WHITE}+|{WHITE}+$", "")), lambda s: s != "")


def strip(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), f"^{WHITE}+|{WHITE}+$", "")


def forum_clean(c: ColumnOrName) -> Column:
    """Without quoted lines, link targets and heading marks."""
    x = F.regexp_replace(_c(c), r"(?m)^>.*$", "")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^\)]+\)", "$1")
    return strip(F.regexp_replace(x, "#+" + WHITE + "*", ""))


def is_bot(c: ColumnOrName) -> Column:
    low = F.lower(_c(c))
    return F.contains(low, F.lit(BOT_PHRASES[0])) | F.contains(low, F.lit(BOT_PHRASES[1])) | F.contains(low, F.lit(BOT_PHRASES[2]))


def excerpt(c: ColumnOrName, n: int) -> Column:
    x = squeeze(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def match_window(c: ColumnOrName, pattern: str, around: int = 100) -> Column:
    """The first match with `around` characters on either side; null without a match."""
    hit = F.regexp_extract(_c(c), pattern, 0)
    at = F.regexp_instr(_c(c), F.lit(pattern))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(_c(c), start, at - start + F.length(hit) + around))


def cjk_share(c: ColumnOrName) -> Column:
    return F.when(F.length(_c(c)) > 0, F.regexp_count(_c(c), F.lit("[一-鿿぀-ヿ가-힯]")) / F.length(_c(c))).otherwise(0.0)


def integers(c: ColumnOrName) -> Column:
    return F.transform(F.regexp_extract_all(_c(c), F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint"))


def near_hash(c: ColumnOrName) -> Column:
    """MD5 of the first 200 characters of the folded text."""
    return F.md5(F.substring(F.regexp_replace(strip(F.lower(_c(c))), WHITE + "+", " "), 1, 200))


def content_key(c: ColumnOrName) -> Column:
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def head_tail(array: Column, n: int) -> Column:
    """The first half and the last half of n tokens where there are more than n."""
    head = n // 2
    return F.when(F.size(array) > n, F.concat(F.slice(array, 1, head), F.slice(array, -(n - head), n - head))).otherwise(array)


def safe_name(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), r"[^A-Za-z0-9_.-]+", "-")


def contains_fuzzily(quote: ColumnOrName, text: ColumnOrName, recall: float = 0.85) -> Column:
    """The quote stands in the text, or `recall` of its distinct tokens do; false for a quote without tokens."""
    q, t = F.array_distinct(tokens(quote)), F.array_distinct(tokens(text))
    exact = F.contains(F.lower(strip(text)), F.lower(strip(quote)))
    return F.when(F.size(q) == 0, False).otherwise(exact | (F.size(F.array_intersect(q, t)) >= recall * F.size(q)))


def keyword_score(c: ColumnOrName, lexicon: tuple[str, ...] = LEXICON_WORDS) -> Column:
    """Ten times the share of distinct tokens that are in the lexicon, at most 1."""
    own = F.array_distinct(tokens(c))
    hits = F.size(F.array_intersect(own, F.array(*map(F.lit, lexicon))))
    return F.least(F.lit(1.0), 10.0 * hits / F.greatest(F.size(own), F.lit(1)))


@F.pandas_udf(DoubleType())
def partial_ratio(quote: pd.Series, text: pd.Series) -> pd.Series:
    """Best share of matching characters of the quote over windows of the text of its length, 0 to 1."""
    from difflib import SequenceMatcher

    def one(q: str | None, t: str | None) -> float | None:
        if q is None or t is None:
            return None
        q, t = (q, t) if len(q) <= len(t) else (t, q)
        if not q or q in t:
            return 1.0
        m, best = SequenceMatcher(None, t, q, autojunk=False), 0.0
        for block in m.get_matching_blocks():
            start = max(0, block.a - block.b)
            best = max(best, SequenceMatcher(None, t[start : start + len(q)], q, autojunk=False).ratio())
        return best

    return pd.Series([one(q, t) for q, t in zip(quote, text, strict=True)], dtype="float64")


def glossed(c: ColumnOrName, glossary: dict[str, str]) -> Column:
    """The text with each term of a short glossary replaced, longest terms first."""
    out = _c(c)
    for term in sorted(glossary, key=lambda t: (-len(t), t)):
        out = F.replace(out, F.lit(term), F.lit(glossary[term]))
    return out


def han_residue(c: ColumnOrName) -> Column:
    """How many Han characters a text still has."""
    return F.regexp_count(_c(c), F.lit("[一-鿿]")).cast("bigint")
