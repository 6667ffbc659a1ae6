"""Problem 1: estimated tokens of every document, and totals per source, language and domain.

The estimate is the number of tokens of the longest-match segmentation of each piece of text over an existing
vocabulary. A trie of the vocabulary carries, at each node, a failure link and the number of tokens that following it
emits, so a piece is counted in one pass, linear in its bytes.

Null and empty texts count 0 tokens and are still records of their slice. A null, blank or unknown source, language or
domain goes to the slice "unknown". Repeated rows count as often as they stand; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import json

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.bpe import PATTERN, TOKENIZERS, byte_letters, vocabulary
from loomtext.llm.common import with_language


class LongestMatch:
    """Counts longest-match tokens of byte strings over a vocabulary that holds every single byte."""

    def __init__(self, words: list[bytes], keep: int = 300_000):
        child: dict[int, int] = {}  # (node << 8 | byte) -> node
        ends = [False]
        parents: list[tuple[int, int]] = [(0, 0)]
        for word in words:
            node = 0
            for byte in word:
                key = node << 8 | byte
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(ends)
                    ends.append(False)
                    parents.append((node, byte))
                node = nxt
            ends[node] = node != 0
        if not all(child.get(b) is not None and ends[child[b]] for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        depth = [0] * len(ends)
        for node in range(1, len(ends)):
            depth[node] = depth[parents[node][0]] + 1
        fail, emits = [0] * len(ends), [0] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[node]:
                emits[node] = 1  # the whole path is one token; the rest starts at the root
                continue
            parent, byte = parents[node]
            at, count = fail[parent], emits[parent]
            while (nxt := child.get(at << 8 | byte)) is None:
                count += emits[at]
                at = fail[at]
            fail[node], emits[node] = nxt, count
        self.child, self.fail, self.emits, self.keep = child, fail, emits, keep
        self.seen: dict[str, int] = {}
        self.pattern = regex.compile(PATTERN)

    def count(self, raw: bytes) -> int:
        child, fail, emits = self.child, self.fail, self.emits
        node = total = 0
        for byte in raw:
            while (nxt := child.get(node << 8 | byte)) is None:
                total += emits[node]
                node = fail[node]
            node = nxt
        while node:
            total += emits[node]
            node = fail[node]
        return total

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        if len(seen) > self.keep:
            seen.clear()
        for piece in self.pattern.findall(text):
            n = seen.get(piece)
            if n is None:
                n = self.count(piece.encode("utf-8", "replace"))
                if len(piece) < 64:
                    seen[piece] = n
            total += n
        return total


@lru_cache(maxsize=2)
def matcher(raw: bytes) -> LongestMatch:
    model, letters = json.loads(raw)["model"], byte_letters()
    return LongestMatch([bytes(letters[c] for c in word) for word in model["vocab"] if all(c in letters for c in word)])


def token_counts(docs: DataFrame, text_col: str = "text", into: str = "n_tokens", path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """docs with column `into`: the estimated number of tokens (BIGINT), 0 for null and empty texts."""
    raw = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("bigint")
    def estimate(text: pd.Series) -> pd.Series:
        count = matcher(raw.value).tokens
        return pd.Series([count(t) for t in text], dtype="int64")

    return docs.withColumn(into, estimate(F.col(text_col)))


def _blank_to_unknown(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "unknown").otherwise(c)


def source_slice(column: str = "source") -> Column:
    """A corpus name without differences of case, outer white space, hyphens and blanks."""
    return _blank_to_unknown(F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), r"[\s-]+", "_"))


def domain_slice(column: str = "domain_name") -> Column:
    """A board name without differences of case, outer white space and the prefix r/."""
    return _blank_to_unknown(F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), r"^/?r/\s*", ""))


def with_slices(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """docs with slice_source, slice_lang and slice_domain."""
    named = with_language(docs, codes, "lang", "slice_lang")
    return named.withColumns({"slice_lang": F.coalesce("slice_lang", F.lit("unknown")), "slice_source": source_slice(), "slice_domain": domain_slice()})


def token_budget(docs: DataFrame, codes: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(source, lang, domain, n_docs, n_tokens): one row per slice; only partial sums are shuffled."""
    counted = token_counts(with_slices(docs.select("text", "source", "lang", "domain_name"), codes), path=path)
    return counted.groupBy(F.col("slice_source").alias("source"), F.col("slice_lang").alias("lang"), F.col("slice_domain").alias("domain")).agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    )


def budget_totals(budget: DataFrame) -> DataFrame:
    """(field, slice, n_docs, n_tokens): totals of each field alone, and of everything under field "all"."""
    exploded = budget.select(
        "n_docs",
        "n_tokens",
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f) if f != "all" else F.lit("all")).alias("slice")) for f in ("source", "lang", "domain", "all")))).alias("s"),
    )
    return exploded.groupBy("s.field", "s.slice").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
