"""What several text operators share: tokens, spelling of splits and languages, hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token: one Han character, or a longest run of other letters and digits, of the lower-cased text.
TOKEN = re.compile("[一-鿿]|[^\\W_一-鿿]+")

_MASK = (1 << 64) - 1


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class TokenHasher:
    """64-bit hashes of tokens; keeps those seen, up to a bound, so that common words are hashed once."""

    def __init__(self, keep: int = 200_000):
        self.seen: dict[str, int] = {}
        self.keep = keep

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        out = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out[k] = h
        return out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix, another one for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` tokens, in order of position."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(hashed[:n], 1)
    for k in range(1, width):
        out = mix(out ^ hashed[k : k + n], k + 1)
    return out


def batches(rows: Iterator[pa.RecordBatch], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows, so that one batch's work arrays stay small."""
    for batch in rows:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def split_name(column: str | Column) -> Column:
    """train, val or test whatever the spelling; null for null, blank and anything else."""
    s = F.lower(F.trim(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"(?U)^\s+|\s+$", "")))
    return F.when(s.isin("train", "training"), "train").when(s.isin("val", "valid", "validation", "dev"), "val").when(s == "test", "test")


def label_key(column: str | Column) -> Column:
    """The comparable part of a language label: trimmed, lower case, without region or script."""
    c = F.col(column) if isinstance(column, str) else column
    return F.element_at(F.split(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "[-_]"), 1)


def language_names(codes: DataFrame) -> DataFrame:
    """(lang_key, lang_code): every accepted spelling of each language of lang_codes.

    The table holds one row per language, a few thousand at most, whatever the corpus.
    """
    return (
        codes.select("code", F.explode(F.array("code", "code3", "english_name")).alias("name"))
        .where("name IS NOT NULL AND code IS NOT NULL")
        .select(F.lower(F.trim("name")).alias("lang_key"), F.lower(F.trim("code")).alias("lang_code"))
        .distinct()
    )


def with_language(docs: DataFrame, codes: DataFrame, label: str, into: str) -> DataFrame:
    """docs with column `into`: the code that `label` names, else null."""
    names = language_names(codes).withColumnRenamed("lang_code", into)
    return docs.withColumn("lang_key", label_key(label)).join(F.broadcast(names), "lang_key", "left").drop("lang_key")
