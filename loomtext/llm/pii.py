"""Problem 2: personal information inside free text, found and replaced by typed placeholders.

Information-theoretic sanitisation. Candidates are taken from every text by shape: strings of digits, pairs of words, forms
of addresses. How strongly a term reveals a protected entity is estimated from its co-occurrence in the whole corpus: the
information that the term gives about the entity is log2 P(entity | term) / P(entity). Terms are words and affixes of
words, shapes of numbers, forms of mail and postal addresses, titles, cues, and the word before a candidate. A few cues
("phone", "passport", "my name is") and titles start the estimate; the words that stand before what they reveal become
cues themselves. A candidate is a finding where the bits of its terms together exceed the disclosure threshold, and is
generalised to a placeholder of its kind, whether or not a cue stands beside it.

Null and empty texts have no findings. Findings of one text don't overlap; mail addresses go before postal ones and
those before all else, then the longer one wins, then the earlier. Rows are independent, repeated doc_ids give findings
of all their texts once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import batches
from loomtext.session import written

#: The disclosure thresholds, in bits: of a word for a name, and of the terms of a number or address together.
NAME_BITS = 2.0
FORM_BITS = 7.0
#: A number whose shape never stands beside a cue of a kind loses so many bits for it.
STRANGE = -4.0
#: Before any text is seen an entity is expected once in so many words, and every second candidate of a form is one.
PRIOR_WORDS = 10_000
#: The context of what stands behind a number.
NUMBER = "#"
#: Bits of the broadcast filter of name terms: 16 for each term, within these bounds of their logarithm (at most 32 MB).
FILTER_BITS = (22, 28)

# Words that start the estimate, in the languages of the corpus.
PHONE_CUES = r"tel|tél|telefon\w*|telephone|phone|mobile?|móvil|cell|celular|whatsapp|fax|handy|call(?: me)?|text|ruf mich|appelle-moi|llámame|ligue|telefone|тел|телефон|звоните|电话是?|手机|致电"
ID_CUES = r"id|id card|ssn|social security|passport|tax id|national insurance|licen[cs]e|steuer-?id|ausweis|personalausweis|reisepass|dni|nie|nif|documento|pasaporte|sécurité sociale|passeport|cpf|rg|passaporte|снилс|инн|паспорт|身份证号?是?|护照号?是?"
NUMBER_GLUE = r"(?:[ -]?(?:number|nummer|numéro|número|номер|n[r.º°]+))?(?: (?:is|ist|es|é|est|est le|at|unter|au|al|para|по номеру))?"
NAME_CUES = (
    r"my name is|i am|i'm|this is|signed,?|contact|ask for|according to|thanks to|written by|i met|mein name ist|ich heiße|frag nach|je m'appelle|demande à|me llamo|mi nombre es|pregunta por"
    r"|meu nome é|me chamo|fale com|меня зовут|мне написала?|author\W{1,5}|--\n"  # the last two: of records and signatures
)
TITLES = r"mr|mrs|ms|(?-i:Miss)|mx|dr|prof|doctora?|docteure?|professora?|profesora?|herr|frau|mme|mlle|monsieur|madame|señora?|sra?|don|doña|dona|senhora?|г-н|г-жа|господин|госпожа"
HAN_NAME_CUES = r"我叫|我是|联系人[:：]|姓名[:：]|署名[:：]"
TLDS = r"com|org|net|edu|gov|info|io|int|example|test|invalid|de|fr|es|pt|br|ru|cn|uk|eu"

_W = r"[^\W\d_一-鿿]"
_WORD = re.compile(rf"{_W}+(?:['’]{_W}+)?")
_NAME_WORD = re.compile(rf"{_W}{{2,}}(?:-{_W}{{2,}})*")
_BETWEEN = re.compile(rf"[ \xa0](?:{_W}\.[ \xa0])?$")
_MAIL_CHARS = frozenset("@_＠+")
_N = _NAME_WORD.pattern
_INITIALED = re.compile(rf"(?<![\w.@]){_W}\. ?(?P<name>{_W}{{3,}}(?:-{_W}{{2,}})*)")
_CUED_PAIR = re.compile(rf"(?:^|(?<=\W))(?:{NAME_CUES})[ :]*(?P<one>{_N})(?P<gap>[ \xa0](?:{_W}\.[ \xa0])?|, )(?P<two>{_N})", re.I)
_TITLED = re.compile(rf"(?<!\w)(?:{TITLES})\.?[ \xa0]+(?P<name>{_W}{{3,}}(?:-{_W}{{2,}})*)", re.I)
_FRENCH_TITLED = re.compile(rf"(?<!\w)M\.[ \xa0]+(?P<name>{_W}{{3,}}(?:-{_W}{{2,}})*)")
_FRENCH = re.compile(r"\b(?:le|la|les|est|et|je|mon|ma|une?|des|du|pour)\b", re.I)
_ENGLISH = re.compile(r"\b(?:the|and|of|to|my|is|for|at|in|on)\b", re.I)
_HAN_NAME = re.compile(rf"({HAN_NAME_CUES})([一-鿿]{{2,4}})(?![一-鿿])")
_HAN_RUN = re.compile("[一-鿿]+")
_HAN_TITLED = re.compile(r"([一-鿿])(先生|女士|小姐|老师)")

_MAIL_SIGN = re.compile(r"(?:\s?[@＠]\s?|\s?[(\[]\s?at\s?[)\]]\s?| at )(?:[^\W_][\w-]*(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?| dot ))+[a-z]{2,12}\b", re.I)
_LOCAL_PART = re.compile(r"[\w.+%-]*[^\W_][\w+%-]*")
_GLUED_MAIL = re.compile(rf"(?<![\w.+%-])[\w.+%-]*?[^\W_]at[a-z][\w-]*?(?:dot[\w-]+?)*dot(?:{TLDS})\b", re.I)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
#: Forms of postal addresses, each with the lower-case strings of which a text of that form holds one.
_ADDRESSES = (
    ((" st", " ave", " road", " rd", " lane", " ln", " drive", " court", " ct", " terrace", " boulevard", " blvd", " place", " square", " sq", " way", " crescent", " close", " row", " parkway"), re.compile(rf"(?<![\w.,-])\d{{1,5}}[a-zA-Z]? (?:{_CAP} ){{1,3}}(?i:street|st|avenue|ave|road|rd|lane|ln|drive|court|ct|terrace|boulevard|blvd|place|square|sq|way|crescent|close|row|parkway)\b")),
    (("box", "postfach", "apartado", "postale", "bp", "b.p", "postal", "а/я", "信箱"), re.compile(r"(?i:\bp\.? ?o\.? ?box \d+|\bpostfach \d+|\bapartado(?: de correos)? \d+|\bbo[îi]te postale \d+|\bB\.?P\.? \d+|\bcaixa postal \d+)|(?<!\w)а/я \d+|信箱\d+号?")),
    (("straße", "strasse", "str.", "weg ", "platz ", "gasse ", "allee ", "ring ", "damm ", "ufer ", "steig "), re.compile(r"\b[A-ZÄÖÜ][\w-]*(?i:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|steig) ?\d+[a-z]?\b|\b[A-ZÄÖÜ][\w-]+ (?i:straße|strasse|str\.|weg|platz|gasse|allee|ring) \d+")),
    ((" rue", " avenue", " allée", " impasse", " boulevard", " place", " chemin", " quai", " cours", " route", " square", " passage"), re.compile(rf"(?<![\w-])\d{{1,4}}[a-z]?(?: bis| ter)?,? (?i:rue|avenue|allée|impasse|boulevard|place|chemin|quai|cours|route|square|passage) (?:(?i:de la|de l['’]|des|du|de|d['’]|l['’]) ?)?{_CAP}")),
    (("calle", "c/", "avenida", "avda", "av.", "plaza", "paseo", "camino", "carretera", "ronda", "rua ", "travessa", "praça", "largo", "alameda", "estrada"), re.compile(rf"(?<!\w)(?i:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|carretera|ronda|rua|travessa|praça|largo|alameda|estrada) ?(?:(?i:de la|de los|de las|del|das|dos|da|do|de) )?{_CAP}(?: {_CAP})*,? (?:n\.?º ?)?\d+")),
    (("ул", "пер", "пр", "пл", "наб", "шоссе", "бульвар"), re.compile(r"(?<!\w)(?i:ул(?:ица|\.)|пер(?:еулок|\.)|пр(?:оспект|-т|осп\.|\.)|пл(?:ощадь|\.)|наб(?:ережная|\.)|шоссе|бульвар) [А-ЯЁ][\w-]+,? (?:(?i:д(?:ом|\.)) ?)?\d+|(?<!\w)[А-ЯЁ][\w-]+ (?i:улица|переулок|проспект|шоссе|бульвар),? (?:(?i:д(?:ом|\.)) ?)?\d+")),
    (("号",), re.compile(r"[一-鿿]{2}(?:路|街|巷|大道|胡同|弄)\d+号")),
)
_PART = r"(?:(?:[A-Z]{0,3}\d+(?:[A-Z]+\d+)*[A-Z]?|[A-Z])(?![^\W一-鿿])|\(\+?\d+\))"
_NUMBER = re.compile(rf"(?<![^\W一-鿿])(?<![/@＠#=&?%+\-_.])(?<!\d[.,:])(?:(?!ID|NO|NR|PO)[A-Z]{{2}} (?=\d)|[A-Z]-(?=\d))?\+?{_PART}(?:(?:[ .\-/\xa0]|(?<=\))|(?=\())(?:{_PART}))*")
_PHONE_CUE = re.compile(rf"(?:^|(?<=\W)|(?<=[一-鿿]))(?:{PHONE_CUES})\.?{NUMBER_GLUE}$", re.I)
_ID_CUE = re.compile(rf"(?:^|(?<=\W)|(?<=[一-鿿]))(?:{ID_CUES})\.?{NUMBER_GLUE}$", re.I)
#: No cue with its glue is longer.
_CUE_CHARS = 64


def shape(number: str) -> str:
    return re.sub("[A-Z]", "A", re.sub(r"\d", "9", number.replace("\xa0", " ")))


def numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, shape) of strings of digits that are long enough for a number of a person."""
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        value = m.group()
        # a short number or a capital that begins the next sentence
        tail = re.search(r"[ \xa0](?:\d{1,2}|[A-Z])$", value)
        if tail and re.match(r"[ '’][a-zа-я]", text[end : end + 2]) and sum(c.isdigit() for c in value[: tail.start()]) >= 7:
            value, end = value[: tail.start()], start + tail.start()
        digits = sum(c.isdigit() for c in value)
        if digits >= 7 or digits >= 5 and sum(c.isalnum() for c in value) >= 8:
            yield start, end, shape(value)


def addresses(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, form, start, end) of what has the form of an e-mail or postal address."""
    for m in _MAIL_SIGN.finditer(text):
        start = m.start()
        while start and (text[start - 1] in "._+%-" or text[start - 1].isalnum()) and not "一" <= text[start - 1] <= "鿿":
            start -= 1
        if _LOCAL_PART.fullmatch(text, start, m.start()):
            sign = m.group().lower()
            yield "email", "m:plain" if "@" in sign or "＠" in sign else "m:bracket" if "(" in sign or "[" in sign else "m:word", start, m.end()
    low = text.lower()
    if "dot" in low:
        for m in _GLUED_MAIL.finditer(text):
            yield "email", "m:glued", m.start(), m.end()
    for k, (needs, pattern) in enumerate(_ADDRESSES):
        if any(x in low for x in needs):
            for m in pattern.finditer(text):
                yield "address", f"p:{k}", m.start(), m.end()


def _before(text: str, start: int, skip: Callable[[str], bool]) -> int:
    while start and skip(text[start - 1]):
        start -= 1
    return start


def number_cue(text: str, start: int) -> str | None:
    end = _before(text, start, lambda c: c.isspace() or c in ":：(")
    before = text[max(0, end - _CUE_CHARS) : end]
    return "phone" if _PHONE_CUE.search(before) else "id_number" if _ID_CUE.search(before) else None


def context(text: str, start: int) -> str | None:
    """The word before a place, or the two Han characters; NUMBER behind a number, null at the beginning."""
    end = _before(text, start, lambda c: not c.isalnum())
    if end and "一" <= text[end - 1] <= "鿿":
        return text[max(0, end - 2) : end]
    if end and text[end - 1].isdigit():
        return NUMBER
    word = text[_before(text, end, str.isalpha) : end]
    return word.lower() or None


def cued_names(text: str) -> Iterator[tuple[str, str]]:
    """(given, family) of names in title case that a cue announces; given is empty for a title."""
    for m in _CUED_PAIR.finditer(text):
        given, family = (m["one"], m["two"]) if m["gap"] != ", " else (m["two"], m["one"])
        if given[:2].istitle() and family[:2].istitle():
            yield given, family
    for m in _TITLED.finditer(text):
        if m["name"][:2].istitle():
            yield "", m["name"]


def titled_names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, family, title) of words behind a title."""
    for m in _TITLED.finditer(text):
        if m["name"][:1].isupper():
            yield m.start("name"), m.end("name"), m["name"], text[m.start() : m.start("name")].strip(" .\xa0").lower()
    if "M." in text and _is_french(text):
        for m in _FRENCH_TITLED.finditer(text):
            yield m.start("name"), m.end("name"), m["name"], "m"


def _is_french(text: str) -> bool:
    return len(_FRENCH.findall(text)) > len(_ENGLISH.findall(text))


def name_pairs(text: str, is_given: Callable[[str], bool], is_family: Callable[[str], bool]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, given, family): a possible given name beside another word; given is empty for an initial or a lone family name."""
    for m in _INITIALED.finditer(text):
        yield m.start(), m.end(), "", m["name"]
    words = [m.span() for m in _NAME_WORD.finditer(text)]
    for k, (a, b) in enumerate(words):
        if b - a > 4 and text[a].isupper() and is_family(text[a:b]) and text[b : b + 1] not in _MAIL_CHARS:
            yield a, b, "", text[a:b]
        if not is_given(text[a:b]) or text[b : b + 1] in _MAIL_CHARS or a and text[a - 1] in _MAIL_CHARS:
            continue
        if k + 1 < len(words):
            c, d = words[k + 1]
            if c - b <= 4 and _BETWEEN.match(text, b, c) and text[d : d + 1] not in _MAIL_CHARS:
                yield a, d, text[a:b], text[c:d]
        if k:
            c, d = words[k - 1]
            if text[d:a] in (" ", "\xa0", ", ") and (not c or text[c - 1] not in _MAIL_CHARS):
                yield c, b, text[a:b], text[c:d]


def _first(word: str) -> str:
    return word.split("-")[0].lower()


def _affixes(word: str) -> tuple[str, str]:
    last = word.split("-")[0].lower()
    return "^" + last[:4], last[-3:] + "$"


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(space, term, n, a, b) over all documents: occurrences, and those beside cues.

    space w: words, and pairs of Han characters, a as a given and b as a family name; x: affixes of words, b as of a
    family name; h: Han characters, b as a family name; d: shapes of numbers, a as a phone and b as an identity number.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            n: Counter[tuple[str, str]] = Counter()
            hits: dict[tuple[str, str], list[int]] = {}
            words: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                words.update(_WORD.findall(text))
                for run_ in _HAN_RUN.findall(text):
                    words.update(run_[k : k + 2] for k in range(len(run_) - 1))
                    for c in run_:
                        n["h", c] += 1
                for m in _HAN_NAME.finditer(text):
                    hits.setdefault(("h", m.group(2)[0]), [0, 0])[1] += 1
                for start, _, form in numbers(text):
                    n["d", form] += 1
                    cue = number_cue(text, start)
                    if cue:
                        hits.setdefault(("d", form), [0, 0])[cue == "id_number"] += 1
                for given, family in cued_names(text):
                    if given:
                        hits.setdefault(("w", _first(given)), [0, 0])[0] += 1
                    hits.setdefault(("w", _first(family)), [0, 0])[1] += 1
                    for affix in _affixes(family):
                        hits.setdefault(("x", affix), [0, 0])[1] += 1
            for word, m in words.items():
                low = word.lower()
                n["w", low] += m
                if len(low) > 3:
                    for affix in _affixes(low):
                        n["x", affix] += m
            for key in hits:
                n.setdefault(key, 0)
            keys = list(n)
            zero = [0, 0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array([n[k] for k in keys], pa.int64()),
                    pa.array([hits.get(k, zero)[0] for k in keys], pa.int64()),
                    pa.array([hits.get(k, zero)[1] for k in keys], pa.int64()),
                ],
                names=["space", "term", "n", "a", "b"],
            )

    counted = docs.select(text_col).mapInArrow(run, "space string, term string, n bigint, a bigint, b bigint")
    return counted.groupBy("space", "term").agg(*(F.sum(c).alias(c) for c in "nab"))


def disclosure(counts: DataFrame) -> DataFrame:
    """(space, term, n, bits_a, bits_b): what the terms that stand beside cues reveal, in bits, about either entity; n_all: all occurrences."""
    spaces = "wxdh"
    whole = counts.groupBy().agg(*(F.sum(F.when((F.col("space") == s) & (F.col(c) > 0), F.col(c))).alias(f"{s}{c}") for s in spaces for c in "ab"), F.sum(F.when(F.col("space").isin("w", "d"), F.col("n"))).alias("n_all"))
    known = counts.join(F.broadcast(whole))  # one row

    def bits(c: str) -> Column:
        hits = F.coalesce(*(F.when(F.col("space") == s, F.col(f"{s}{c}")) for s in spaces), F.lit(0))
        base = (hits + 1) / (F.col("n_all") + PRIOR_WORDS)
        return F.when(F.col(c) > 0, F.log2(F.col(c) / F.greatest("n", c) / base)).otherwise(F.lit(-99.0))

    return known.select("space", "term", "n", "n_all", bits("a").alias("bits_a"), bits("b").alias("bits_b"))


def _filter_of(terms: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of the words and affixes that may be of names; false hits are settled by the join that follows."""
    named = terms.where(f"(space = 'w' AND bits_a >= {NAME_BITS}) OR (space = 'x' AND bits_b >= 0)").select("term")
    size = min(max(FILTER_BITS[0], named.count().bit_length() + 4), FILTER_BITS[1])
    slot = F.pmod(F.xxhash64("term"), F.lit(1 << size))
    # at most 2**(FILTER_BITS[1] - 6) rows
    cells = named.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(term), {1 << size}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return size, out


def _slot(word: str, size: int) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & ((1 << size) - 1)


_CANDIDATES = (("doc_id", "bigint"), ("kind", "string"), ("start_char", "int"), ("end_char", "int"), ("given", "string"), ("family", "string"), ("form", "string"), ("cue", "string"), ("context", "string"))


def candidates(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start_char, end_char, given, family, form, cue, context): what may be personal information by its form.

    form is the shape of a number, the form of an address, the title or cue of a name; cue is the kind that a cue before
    a number names; context is the word before.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(terms))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, cells = shared.value
        given, family = {}, {}

        def held(word: str) -> bool:
            slot = _slot(word, size)
            return bool(int(cells[slot >> 6]) >> (slot & 63) & 1)

        def is_given(word: str) -> bool:
            got = given.get(word)
            if got is None:
                got = given[word] = held(_first(word))
            return got

        def is_family(word: str) -> bool:
            got = family.get(word)
            if got is None:
                got = family[word] = all(held(x) for x in _affixes(word))
            return got

        for batch in batches(rows):
            out: list[tuple] = []
            for seen in (given, family):
                if len(seen) > 200_000:
                    seen.clear()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                out += [(i, kind, a, b, None, None, form, None, context(text, a)) for kind, form, a, b in addresses(text)]
                out += [(i, "number", a, b, None, None, form, number_cue(text, a), context(text, a)) for a, b, form in numbers(text)]
                out += [(i, "han", m.start(2), m.end(2), None, m.group(2)[0], f"h:{m.group(1)}", None, None) for m in _HAN_NAME.finditer(text)]
                for m in _HAN_TITLED.finditer(text):
                    alone = not m.start() or not "一" <= text[m.start() - 1] <= "鿿"
                    out.append((i, "han", m.start(1), m.end(1), None, m.group(1), f"h:{m.group(2)}" if alone else None, None, None))
                out += [(i, "titled", a, b, None, f.lower(), f"t:{title}", None, None) for a, b, f, title in titled_names(text)]
                out += [(i, "name", a, b, _first(g) or None, f.lower(), None, None, context(text, a)) for a, b, g, f in name_pairs(text, is_given, is_family)]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(_CANDIDATES)
            types = {"bigint": batch.schema.field(0).type, "string": pa.string(), "int": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, _CANDIDATES, strict=True)], names=[n for n, _ in _CANDIDATES])

    return docs.select("doc_id", text_col).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _CANDIDATES))


def _form_bits(rows: DataFrame, told: Column, entities: DataFrame) -> DataFrame:
    """(kind, form, form_bits): of the forms in rows; told: whether other terms reveal the candidate; entities: (kind, base)."""
    counted = rows.groupBy("kind", "form").agg(F.count("*").alias("n"), F.sum(told.cast("long")).alias("told"))
    return counted.join(entities, "kind").select("kind", "form", F.log2((F.col("told") + 1) / (F.col("n") + 2) / F.col("base")).alias("form_bits"))


def _bases(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, base): the probability of an entity of each kind at a word."""
    size = terms.agg(F.coalesce(F.max("n_all"), F.lit(0)).alias("n_all"))
    return rows.groupBy("kind").count().join(F.broadcast(size)).select("kind", ((F.col("count") + 1) / (F.col("n_all") + PRIOR_WORDS)).alias("base"))  # one row


def learnt_cues(rows: DataFrame, terms: DataFrame, bases: DataFrame) -> DataFrame:
    """(kind, context, context_bits): the words before the candidates (kind, context) that reveal them by at least a bit."""
    hits = rows.where("context IS NOT NULL").groupBy("kind", "context").agg(F.count("*").alias("hits"))
    numbers_ = terms.where("space = 'd'").agg(F.lit(NUMBER).alias("context"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    seen = hits.join(terms.where("space = 'w'").select(F.col("term").alias("context"), "n").unionByName(numbers_), "context").join(bases, "kind")
    bits = F.log2(F.col("hits") / F.greatest("n", "hits") / F.col("base"))
    return seen.select("kind", "context", bits.alias("context_bits")).where("context_bits >= 1")


def findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start_char, end_char): every piece of personal information."""
    terms = written(disclosure(term_counts(docs, text_col)), "terms")
    found = written(candidates(docs, terms, text_col).distinct(), "candidates")
    place = ("doc_id", "kind", "start_char", "end_char")
    nothing = F.lit(0.0)

    # numbers: bits of shape, cue and context for either kind
    shapes = terms.where("space = 'd'").select(F.col("term").alias("form"), F.greatest("bits_a", F.lit(STRANGE)).alias("phone"), F.greatest("bits_b", F.lit(STRANGE)).alias("id_number"))
    digits = written(found.where("kind = 'number'").join(shapes, "form", "left").fillna(STRANGE, ["phone", "id_number"]), "digits")
    likely = F.when(F.col("phone") >= F.col("id_number"), "phone").otherwise("id_number")
    strong = digits.where(F.greatest("phone", "id_number") >= FORM_BITS).withColumn("kind", likely)
    bases = written(_bases(strong, terms), "bases")
    cues = written(learnt_cues(strong, terms, bases), "cues")
    stated = _form_bits(digits.where("cue IS NOT NULL").select(F.col("cue").alias("kind"), F.col("cue").alias("form"), likely.alias("likely")), F.col("likely") == F.col("kind"), bases)
    total = digits
    for kind in ("phone", "id_number"):
        own = cues.where(F.col("kind") == kind).select("context", F.col("context_bits").alias(f"{kind}_context"))
        total = total.join(own, "context", "left")
    total = total.join(F.broadcast(stated.select(F.col("form").alias("cue"), "form_bits")), "cue", "left")  # a row for each kind of number
    for kind in ("phone", "id_number"):
        total = total.withColumn(kind, F.col(kind) + F.coalesce(f"{kind}_context", nothing) + F.when(F.col("cue") == kind, F.coalesce("form_bits", nothing)).otherwise(nothing))
    told = total.where(F.greatest("phone", "id_number") >= FORM_BITS).withColumn("kind", likely).select(*place)

    # mail and postal addresses: bits of form and context
    formed = found.where("kind IN ('email', 'address')")
    bases = written(_bases(formed, terms), "bases")
    formed = written(formed.join(learnt_cues(formed, terms, bases), ["kind", "context"], "left"), "formed")
    forms = _form_bits(formed, F.col("context_bits").isNotNull(), bases)
    addressed = formed.join(forms, ["kind", "form"]).where(F.col("form_bits") + F.coalesce("context_bits", nothing) >= FORM_BITS).select(*place)

    # names: bits of the given name; of the family name or its affixes, with title and context
    words, affixes = terms.where("space = 'w'"), terms.where("space = 'x'").select("term", "bits_b")
    first = F.split_part("family", F.lit("-"), F.lit(1))
    named = (
        found.where("kind IN ('name', 'titled')")
        .withColumns({"term_f": first, "term_p": F.concat(F.lit("^"), F.left(first, F.lit(4))), "term_s": F.concat(F.right(first, F.lit(3)), F.lit("$"))})
        .join(words.where("bits_b > -99").select(F.col("term").alias("term_f"), F.col("bits_b").alias("family_bits")), "term_f", "left")
        .join(affixes.select(F.col("term").alias("term_p"), F.col("bits_b").alias("prefix_bits")), "term_p", "left")
        .join(affixes.select(F.col("term").alias("term_s"), F.col("bits_b").alias("suffix_bits")), "term_s", "left")
        .fillna(-99.0, ["family_bits", "prefix_bits", "suffix_bits"])
        .withColumn("bits", F.greatest("family_bits", (F.col("prefix_bits") + F.col("suffix_bits")) / 2))
    )
    named = written(named.select(*place, "given", "form", "context", "bits"), "named")
    paired = named.where("given IS NOT NULL").join(words.where(F.col("bits_a") >= NAME_BITS).select(F.col("term").alias("given")), "given")
    sure = paired.where(F.col("bits") >= NAME_BITS)
    bases = written(_bases(sure, terms), "bases")
    cued = paired.join(learnt_cues(sure, terms, bases), ["kind", "context"], "left").where(F.col("bits") + F.coalesce("context_bits", nothing) >= NAME_BITS)
    lone = named.where("kind = 'name' AND given IS NULL").where(F.col("bits") >= 2 * NAME_BITS)
    titled = named.where("kind = 'titled'")
    titles = _form_bits(titled, F.col("bits") >= NAME_BITS, _bases(titled, terms))
    titled = titled.where(F.col("bits") >= NAME_BITS).join(titles, ["kind", "form"]).where(F.col("form_bits") + F.col("bits") >= FORM_BITS)

    # Han names: bits of the cue or title, and of the first character as a family name
    han = found.where("kind = 'han'").join(terms.where("space = 'h'").select(F.col("term").alias("family"), "bits_b"), "family", "left").fillna(-99.0, ["bits_b"])
    han = written(han, "han")
    cues = _form_bits(han.where("form IS NOT NULL"), F.col("bits_b") >= NAME_BITS, _bases(han, terms))
    han = han.join(cues, ["kind", "form"], "left").where(F.coalesce("form_bits", nothing) + F.when(F.col("form").isNull(), F.col("bits_b")).otherwise(F.greatest("bits_b", nothing)) >= 2 * NAME_BITS)

    names = cued.select(*place).unionByName(lone.select(*place)).unionByName(titled.select(*place)).unionByName(han.select(*place))
    return _apart(addressed.unionByName(told).unionByName(names.withColumn("kind", F.lit("name"))).distinct())


def _apart(spans: DataFrame) -> DataFrame:
    """spans without those that overlap one that goes before them: mail, then postal addresses, then the longer, the earlier.

    Only spans that hang together by overlaps are compared.
    """
    spans = spans.withColumn("rank", F.when(F.col("kind") == "email", 0).when(F.col("kind") == "address", 1).otherwise(2))
    by_place = Window.partitionBy("doc_id").orderBy("start_char", "end_char", "kind")
    new = F.coalesce(F.col("start_char") >= F.max("end_char").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    parts = spans.withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(by_place))
    lists = parts.groupBy("doc_id", "part").agg(F.sort_array(F.collect_list(F.struct("rank", (F.col("start_char") - F.col("end_char")).alias("size"), "start_char", "end_char", "kind"))).alias("all"))
    kept = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<rank:int,size:int,start_char:int,end_char:int,kind:string>>)"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (x["start_char"] < y["end_char"]) & (y["start_char"] < x["end_char"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return lists.select("doc_id", F.explode(kept).alias("k")).select("doc_id", "k.kind", "k.start_char", "k.end_char")


def sanitised(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_found, clean_text): each finding is replaced by [KIND], the rest of the text is as it was."""
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "kind"))).alias("spans"))
    joined = docs.select("doc_id", text_col).join(spans, "doc_id", "left")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts, counts = [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, end = [], 0
                for s in own or ():
                    parts += [text[end : s["start_char"]], f"[{s['kind'].upper()}]"]
                    end = s["end_char"]
                texts.append(None if text is None else "".join(parts) + text[end:])
                counts.append(len(own or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "n_found", "clean_text"])

    return joined.mapInArrow(run, "doc_id bigint, n_found int, clean_text string")
