"""Problem 8: text decoded in a wrong character encoding, found and restored.

A hidden Markov model labels characters with one clean state or one state per encoding pair (the encoding the bytes were
in, the one they were read in). Each state's emissions are smoothed character pairs; those of a pair's state are
learnt from clean text that was put through the pair. A labelled span gets its state's inverse transform, and the
result is labelled again until nothing changes, so repeated errors are undone one by one, however many. Letters lost to
"?" are a state that is open only where a word of the corpus with other than ASCII letters fits the word with the signs
in it; letters lost to U+FFFD are a state that emits this sign alone; they are found but can't be restored.

Null and empty texts are clean. Rows are independent, repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import codecs
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import batches

#: Fixed values: (encoding of the bytes, encoding they were read in).
PAIRS = (
    ("utf-8", "latin-1"),
    ("utf-8", "cp1252"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp1251"),
    ("utf-8", "koi8_r"),
    ("utf-8", "cp866"),
    ("utf-8", "gbk"),
    ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"),
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1252"),
    ("cp866", "cp1251"),
    ("cp1252", "mac_roman"),
    ("mac_roman", "cp1252"),
    ("cp1252", "cp437"),
    ("cp1252", "cp1251"),
    ("gbk", "cp1252"),
)
LOST = len(PAIRS) + 1
SUBSTITUTE = LOST + 1
STATES = SUBSTITUTE + 1
#: The model is fitted on all documents; so many characters of them are counted at once.
FIT_CHARS = 4_000_000
#: How often a text counts as it stands, and in capitals, as some texts are.
PLAIN, CAPITALS = 8, 1
#: log P of the sign U+FFFD in the clean state and that of letters lost to "?", in those of encodings, in its own.
SIGN = (-30.0, -3.0, -0.1)
_NEVER = -50.0
#: Cost, in nats, of leaving the clean state, and of leaving it for a substitute sign, of coming back; and by how much a restored span must be the likelier text.
SWITCH, SWITCH_TO_SIGN, BACK = 11.0, 1.0, 0.5
MARGIN = 4.0
_HAN = (0x4E00, 0x9FFF)
_INNER_QUESTION = r"(?U)\p{L}\?+\p{L}"
#: A word of the text with question marks inside it.
QUESTION_WORD = re.compile(r"[^\W\d_]*(?:\?+[^\W\d_]+)+")


def _sloppy(codec: str) -> str:
    """The 256 characters of a one-byte codec; an undefined byte stands for the control character of the same number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars)


@lru_cache(maxsize=None)
def _one_byte(codec: str) -> tuple[str, Any] | None:
    if codec in ("utf-8", "gbk"):
        return None
    chars = _sloppy(codec)
    return chars, codecs.charmap_build(chars)


def _to_bytes(text: str, codec: str) -> bytes:
    table = _one_byte(codec)
    return codecs.charmap_encode(text, "ignore", table[1])[0] if table else text.encode(codec, "ignore")


def _to_text(raw: bytes, codec: str) -> str:
    table = _one_byte(codec)
    return codecs.charmap_decode(raw, "replace", table[0])[0] if table else raw.decode(codec, "replace")


def garble(text: str, pair: tuple[str, str]) -> str:
    """text as it looks after its bytes in pair[0] were read in pair[1]."""
    return _to_text(_to_bytes(text, pair[0]), pair[1])


def restore(text: str, pair: tuple[str, str]) -> str:
    return _to_text(_to_bytes(text, pair[1]), pair[0])


def _utf8_units() -> re.Pattern[str]:
    """Characters that look like the bytes of a UTF-8 sequence read in a one-byte encoding; of a Cyrillic one, two sequences."""
    parts = []
    for codec, times in (("cp1252", 1), ("latin-1", 1), ("cp437", 1), ("mac_roman", 1), ("cp1251", 2)):
        chars = _one_byte(codec)[0]
        of = lambda a, b: "[" + "".join(map(re.escape, chars[a:b])) + "]"
        # first bytes of accented Latin letters and of Cyrillic; then of punctuation and Han characters
        two = f"[{chars[0xC3]}{chars[0xC5]}{chars[0xD0:0xD2]}]{of(0x80, 0xC0)}" if times == 1 else f"(?:{of(0xD0, 0xD2)}{of(0x80, 0xC0)}){{2}}"
        parts.append(f"{two}|{of(0xE2, 0xE3) if times == 2 else of(0xE2, 0xEA)}{of(0x80, 0xC0)}{{2}}")
    return re.compile("|".join(parts))


@lru_cache(maxsize=1)
def utf8_units() -> re.Pattern[str]:
    return _utf8_units()


@dataclass
class Model:
    """Character ids, and tables over them with a column for each state.

    ids: of each code; 0 for one not seen, 1 for any Han character. pairs: log P(this | previous) of the pairs of ids that
    were seen in any state, in the order of keys; of other pairs it is one[this] + row[previous]. han: of Han characters.
    """

    ids: np.ndarray
    keys: np.ndarray
    pairs: np.ndarray
    one: np.ndarray
    row: np.ndarray
    han: np.ndarray

    def pair(self, before: np.ndarray, this: np.ndarray) -> np.ndarray:
        out = self.one[this] + self.row[before]
        wanted = before.astype(np.int64) * len(self.one) + this
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        out[hit] = self.pairs[at[hit]]
        return out

    def emissions(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P of the characters at the places `at` after those before them, for each state: (places, states)."""
        before = np.where(at > 0, self.ids[codes[at - 1]], self.ids[10])
        this = codes[at]
        out = self.pair(before, self.ids[this]).astype(np.float64)
        han = (this >= _HAN[0]) & (this <= _HAN[1])
        if han.any():
            out[han] += self.han[this[han] - _HAN[0]]
        sign = this == 0xFFFD
        out[~sign & (at > 0) & (codes[at - 1] == 0xFFFD)] = 0  # what follows a substitute sign says nothing about the encoding
        out[:, SUBSTITUTE] = _NEVER
        out[sign] = SIGN[1]
        out[np.ix_(sign, [0, LOST])] = SIGN[0]
        out[sign, SUBSTITUTE] = SIGN[2]
        return out

    def clean_score(self, before: str, text: str, after: str) -> float:
        """log P of text as clean text between its neighbours; substitute signs count as rare characters."""
        codes = _codes((before or "\n") + text + after)
        ids = self.ids[codes]
        score = float(self.pair(ids[:-1], ids[1:])[:, 0].sum())
        han = codes[(codes >= _HAN[0]) & (codes <= _HAN[1])]
        return score + float(self.han[han - _HAN[0], 0].sum()) - 14.0 * text.count("\ufffd")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@lru_cache(maxsize=None)
def _encodable(codec: str) -> np.ndarray:
    """Of each code, whether the one-byte codec has its character."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in _one_byte(codec)[0]]] = True
    return out


def states_of(texts: list[str]) -> list[int]:
    """Bits of the states that a text trains: the clean one, and those of errors that change it and fit its script."""
    codes = _codes("".join(texts))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    odd = codes > 127
    codes, owner = codes[odd], owner[odd]
    per_text = lambda what: np.bincount(owner, weights=what, minlength=len(texts))
    n = per_text(np.ones(len(codes)))
    han = per_text((codes >= _HAN[0]) & (codes <= _HAN[1])) > 0
    latin = per_text((codes > 0x24F) & ~((codes >= 0x2000) & (codes <= 0x206F))) == 0
    bits = 1 | ((n > 0) & latin).astype(np.int64) << LOST
    for k, pair in enumerate(PAIRS):
        fits = (n > 0) & (han if "gbk" in pair else True)
        if _one_byte(pair[0]):
            fits = fits & (per_text(_encodable(pair[0])[codes]) >= 0.7 * n)
        bits |= fits.astype(np.int64) << (k + 1)
    return bits.tolist()


def through(text: str, state: int) -> str:
    """text as the error of a state leaves it."""
    if state == 0:
        return text
    return re.sub(r"[^\x00-\x7f]", "?", text) if state == LOST else garble(text, PAIRS[state - 1])


def _count(words: Counter[str], state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, this, count) of the characters of words, each after a blank; previous -1 for counts of single characters.

    No error makes or takes a blank, so a word is put through its state once, however often it stands in the texts.
    """
    c = _codes(through(" " + " ".join(words), state) + " ")
    weights = np.fromiter(words.values(), np.float64, len(words))[np.cumsum(c[:-1] == 32) - 1]
    n1 = np.bincount(c[:-1], weights=weights)
    folded = np.where((c >= _HAN[0]) & (c <= _HAN[1]), _HAN[0], c)
    seen = np.flatnonzero(np.bincount(folded))
    ids = np.zeros(seen[-1] + 1, np.int64)
    ids[seen] = np.arange(len(seen))
    keys = ids[folded[:-1]] * len(seen) + ids[folded[1:]]
    if len(seen) ** 2 <= 1 << 22:
        n2 = np.bincount(keys, weights=weights)
        pairs = np.flatnonzero(n2)
        n2 = n2[pairs]
    else:
        pairs, at = np.unique(keys, return_inverse=True)
        n2 = np.bincount(at, weights=weights)
    one = np.flatnonzero(n1)
    return np.concatenate([seen[pairs // len(seen)], np.full(len(one), -1)]), np.concatenate([seen[pairs % len(seen)], one]), np.concatenate([n2, n1[one]])


def counts_of(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(state, previous, this, count); previous -1 for counts of single characters.

    A text counts PLAIN times as it stands, one of other than ASCII characters CAPITALS times in capitals.
    """
    ascii_ = [t for t in texts if t and t.isascii()]
    odd = [t for t in texts if t and not t.isascii() and "\ufffd" not in t and not re.search("[\x80-\x9f]", t) and not utf8_units().search(t)]
    capitals = [t.upper() for t in odd]
    groups: dict[int, Counter[str]] = {}
    ends: Counter[int] = Counter()
    for group, bits, times in ((ascii_, [1] * len(ascii_), PLAIN), (odd, states_of(odd), PLAIN), (capitals, states_of(capitals), CAPITALS)):
        once: dict[int, Counter[str]] = {}
        for text, b in zip(group, bits, strict=True):
            once.setdefault(b, Counter()).update(f"\n{text}\n".split(" "))
            ends[b] += times
        for b, words in once.items():
            own = groups.setdefault(b, Counter())
            for w, n in words.items():
                own[w] += n * times
    for state in range(SUBSTITUTE):
        words, n = Counter(), 0
        for b, own in groups.items():
            if b >> state & 1:
                words.update(own)
                n += ends[b]
        if words:
            yield state, *_count(words, state)
            # the blanks before texts, and one of the two ends of lines around each, stand in no text
            yield state, np.array([32, 10, -1, -1]), np.array([10, 32, 32, 10]), np.full(4, -float(n))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model, from all documents; the counts that reach the driver are those of their characters."""
    texts = docs.select(F.col(text_col).alias("text")).where("text <> ''")

    def run(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        room = FIT_CHARS

        def counted() -> Iterator[pa.RecordBatch]:
            for state, before, code, n in counts_of(held):
                columns = [pa.array(np.full(len(n), state)), pa.array(before.astype(np.int64)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["state", "before", "code", "n"])

        for batch in batches(batch_rows, 500):
            for text in batch.column(0).to_pylist():
                held.append(text)
                room -= len(text)
                if room <= 0:
                    yield from counted()
                    held, room = [], FIT_CHARS
        yield from counted()

    counted = texts.mapInArrow(run, "state long, before long, code long, n long")
    table = counted.groupBy("state", "before", "code").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    return build(*(table.column(c).to_numpy() for c in ("state", "before", "code", "n")))


def build(state: np.ndarray, before: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    single = before < 0
    han_code = (code >= _HAN[0]) & (code <= _HAN[1])
    alphabet = np.unique(np.concatenate([code[single & ~han_code], [10]]))
    ids = np.zeros(0x110000, np.int32)
    ids[alphabet] = np.arange(2, len(alphabet) + 2)
    ids[_HAN[0] : _HAN[1] + 1] = 1
    size = len(alphabet) + 2
    left, right, s, m = ids[before[~single]].astype(np.int64), ids[code[~single]].astype(np.int64), state[~single], n[~single] / PLAIN
    keys, at = np.unique(np.concatenate([left * size + right, [0]]), return_inverse=True)
    together, rows, one = np.zeros((len(keys), STATES)), np.zeros((size, STATES)), np.zeros((size, STATES))
    np.add.at(together, (at[:-1], s), m)
    np.add.at(rows, (left, s), m)
    np.add.at(one, (right, s), m)
    one = np.maximum(one / np.maximum(1.0, one.sum(axis=0)), np.where(np.arange(STATES) == 0, 3e-7, 1e-9))
    row = -np.log(rows + 4.0)
    pairs = np.log(together + 4.0 * one[keys % size]) + row[keys // size]
    han = np.zeros((_HAN[1] - _HAN[0] + 1, STATES))
    own = single & han_code
    np.add.at(han, (code[own] - _HAN[0], state[own]), n[own] / PLAIN)
    least = np.where(np.arange(STATES) == 0, 0.02, 1e-4)
    han = np.log((han + least) / (han.sum(axis=0) + least * len(han)))
    return Model(ids, keys, *(x.astype(np.float32) for x in (pairs, np.log(4.0 * one), row, han)))


def hinted(text: str, words: dict[str, str]) -> dict[int, str]:
    """Places of question marks inside words that fit a word of the corpus, with the letter lost there."""
    out: dict[int, str] = {}
    if not words:
        return out
    for m in QUESTION_WORD.finditer(text):
        word = words.get(m.group().lower())
        if word:
            for k, c in enumerate(m.group()):
                if c == "?":
                    low = word[k]
                    out[m.start() + k] = low.upper() if m.group().isupper() or (k == 0 and len(m.group()) > 1 and m.group()[1:2].isupper()) else low
    return out


def label(text: str, model: Model, lost: dict[int, str]) -> np.ndarray:
    """The state of each character; those between two characters of one state have it too."""
    codes = _codes(text)
    n = len(codes)
    labels = np.zeros(n, np.int64)
    odd = codes > 127
    if lost:
        odd[list(lost)] = True
    use = odd.copy()
    use[1:] |= odd[:-1]
    at = np.flatnonzero(use)
    if not len(at):
        return labels
    emit = model.emissions(codes, at)
    # the state of lost letters is open at hinted question marks only
    open_ = np.zeros(n, bool)
    if lost:
        open_[list(lost)] = True
        after = np.flatnonzero(open_) + 1
        open_[after[after < n]] = True
    shut = ~open_[at]
    emit[shut, LOST] = np.where(odd[at][shut], emit[shut, 0] - 4.0, emit[shut, 0])
    # a run of a state pays only where it gains on the clean state what entering costs; runs that don't are in no best path
    ahead = np.vstack([np.zeros(STATES), np.cumsum(emit - emit[:, :1], axis=0)])
    gain = (ahead[1:] - np.minimum.accumulate(ahead[:-1], axis=0)).max(axis=0)
    states = np.concatenate([[0], 1 + np.flatnonzero(gain[1:] > np.where(np.arange(1, STATES) == SUBSTITUTE, SWITCH_TO_SIGN, SWITCH - BACK))])
    if len(states) == 1:
        return labels
    e, order = np.ascontiguousarray(emit[:, states]), np.arange(len(states))
    signs = states[-1] == SUBSTITUTE
    best, back = e[0] - np.where(states == SUBSTITUTE, SWITCH_TO_SIGN, np.where(states > 0, SWITCH, 0)), np.zeros((len(at), len(states)), np.int64)
    cost = np.where(states == 0, BACK, SWITCH)
    for k in range(1, len(at)):
        top = best.argmax()
        hop = best[top] - cost
        back[k] = np.where(best >= hop, order, top)
        if signs and best[0] - SWITCH_TO_SIGN > max(hop[-1], best[-1]):
            hop[-1], back[k, -1] = best[0] - SWITCH_TO_SIGN, 0
        best = np.maximum(best, hop) + e[k]
    s = int(best.argmax())
    path = np.empty(len(at), np.int64)
    for k in range(len(at) - 1, -1, -1):
        path[k] = s
        s = back[k, s]
    path = states[path]
    labels[at] = path
    # a span reaches from the first to the last of neighbouring characters of one state
    for k in range(1, len(at)):
        if path[k] and path[k] == path[k - 1]:
            labels[at[k - 1] : at[k]] = path[k]
    return labels


def _spans(labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.diff(labels)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(labels)], strict=True):
        if b > a and labels[a]:
            yield a, b, int(labels[a])


def repair(text: str, model: Model, words: dict[str, str]) -> tuple[str, list[str]]:
    """The restored text and the names of the errors found, in the order in which they were undone.

    Every change makes the text likelier as clean text by more than MARGIN, so the rounds come to an end.
    """
    found: list[str] = []
    while True:
        lost = hinted(text, words)
        out, end, changed, signs = [], 0, False, False
        for a, b, s in _spans(label(text, model, lost)):
            part, reach = text[a:b], b
            if s == SUBSTITUTE:
                signs = True
                continue
            if s == LOST:
                new, name = "".join(lost.get(a + k, c) for k, c in enumerate(part)), "lost"
            else:
                if PAIRS[s - 1][0] == "utf-8" and text[b : b + 1] == " " and _to_bytes(part[-1], PAIRS[s - 1][1]) == b"\xc3":
                    part, reach = part + _to_text(b"\xa0", PAIRS[s - 1][1]), b + 1  # the hard space of an "à" became a plain one
                new, name = restore(part, PAIRS[s - 1]), ">".join(PAIRS[s - 1])
            around = text[max(0, a - 1) : a], text[reach : reach + 1]
            if new == part or model.clean_score(around[0], new, around[1]) <= MARGIN + model.clean_score(around[0], part, around[1]):
                signs |= "\ufffd" in part
                continue  # what was put back must be the likelier text
            out += [text[end:a], new]
            end, changed = reach, True
            found.append(name)
        if not changed:
            return text, [*found, "substitute"] if signs else found
        text = "".join(out) + text[end:]


def lost_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, words ARRAY<STRUCT<shape, word>>): for words with question marks inside, the corpus word that fits.

    The most frequent word of all documents with the same letters around the signs wins, ties go to the first in order.
    """
    asked = (
        docs.where(F.col(text_col).rlike(_INNER_QUESTION) | F.col(text_col).rlike(r"(?U)(^|\s)\?\p{L}"))
        .select(id_col, F.explode(F.array_distinct(F.transform(F.expr(f"regexp_extract_all({text_col}, '(?U)[\\\\p{{L}}]*(\\\\?+\\\\p{{L}}+)+', 0)"), F.lower))).alias("shape"))
        .where("shape rlike '[a-z]'")
    )
    words = (
        docs.where(F.col(text_col).rlike(r"[^\x00-\x7f]"))
        .select(F.explode(F.expr(f"regexp_extract_all({text_col}, '(?U)\\\\p{{L}}*[\\\\u00c0-\\\\u024f]\\\\p{{L}}*', 0)")).alias("word"))
        .where("word rlike '[a-zA-Z]'")
        .groupBy(F.lower("word").alias("word"))
        .count()
        .withColumn("shape", F.regexp_replace("word", r"[^\x00-\x7f]", "?"))
    )
    best = words.groupBy("shape").agg(F.max_by("word", F.struct(F.col("count"), F.col("word"))).alias("word"))
    return asked.join(best, "shape").groupBy(id_col).agg(F.collect_list(F.struct("shape", "word")).alias("words"))


def repairs(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, restored STRING, errors ARRAY<STRING>) of the affected documents."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    model = model or fit(docs, text_col)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # of the size of the pairs of characters in the documents
    # a text of ASCII characters alone can only have lost letters
    odd = docs.where(F.col(text_col).rlike(r"[^\x00-\x7f]") | F.col(text_col).rlike(r"\?\p{L}"))
    asked = odd.join(lost_words(docs, text_col, id_col), id_col, "left")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for batch in batches(rows):
            ids, texts, errors = [], [], []
            for i, text, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                restored, found = repair(text, m, {w["shape"]: w["word"] for w in words or ()})
                if found:
                    ids.append(i)
                    texts.append(restored)
                    errors.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(texts, pa.string()), pa.array(errors, pa.list_(pa.string()))], names=[id_col, "restored", "errors"])

    return asked.select(id_col, text_col, "words").mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, restored string, errors array<string>")


@lru_cache(maxsize=2)
def _model(raw: bytes) -> Any:
    return pickle.loads(raw)
