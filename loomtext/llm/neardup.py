"""Problem 3: near-duplicate texts with small edits, by HyperMinHash.

Equal texts form one class and are sketched once. A sketch has several hash functions; each cuts its hash space into
buckets and keeps, for a bucket's least hash, the number of leading zeros and some mantissa bits in one 16-bit
register. Bands of registers give candidates; the share of equal registers, corrected for registers that are equal by
chance, estimates the Jaccard similarity and drops the clearly different ones; the rest is verified on the exact
sets of token runs.

Null, empty and short texts (fewer than min_tokens tokens) have no near-duplicates. Of repeated rows of
one doc_id one counts; other columns are ignored. At the defaults a pair of similarity 0.5, 0.55 or 0.6 becomes a candidate with
probability 0.983, 0.9986 or 0.99996.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import TokenHasher, batches, mix, shingles
from loomtext.llm.copies import classes, components, expand, sorted_shingles, token_arrays, with_shared
from loomtext.session import dropped, written

BUCKET_BITS = 3
HASHES = 80
ROWS_PER_BAND = 5
MANTISSA_BITS = 10
#: Registers that are kept for the estimate.
ESTIMATE = 128
#: A band of about so many documents or more is hot; found from one document in HOT_SAMPLE.
HOT_BAND = 2048
HOT_SAMPLE = 64

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_U = np.uint64


def registers(grams: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """uint16 registers (count, HASHES << BUCKET_BITS) of documents; owner is each gram's document."""
    buckets = 1 << BUCKET_BITS
    out = np.empty((count, HASHES, buckets), np.uint64)
    base = owner.astype(np.int64) << BUCKET_BITS
    for k in range(HASHES):
        h = mix(grams, 1000 + k)
        least = np.full(count * buckets, _EMPTY)
        np.minimum.at(least, base + (h >> _U(64 - BUCKET_BITS)).astype(np.int64), h << _U(BUCKET_BITS))
        out[:, k] = least.reshape(count, buckets)
    return compress(out.reshape(count, -1))


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the mantissa bits behind the first one; 0xFFFF for an empty bucket."""
    # the exponent of the float nearest to the upper 52 bits is exact
    top = least >> _U(12)
    exponent = np.frexp(top.astype(np.float64))[1]
    zeros = np.minimum(52 - exponent, 62).astype(np.uint64)
    mantissa = ((least << zeros) << _U(1)) >> _U(64 - MANTISSA_BITS)
    return np.where(least == _EMPTY, _U(0xFFFF), zeros << _U(MANTISSA_BITS) | mantissa).astype(np.uint16)


@lru_cache(maxsize=1)
def _chance() -> np.ndarray:
    """Probability that registers of two disjoint sets of 2**(i/2) and 2**(j/2) grams a bucket are equal."""
    levels, cells = np.arange(40), np.arange(1 << MANTISSA_BITS)
    lower = (2.0 ** -(levels + 1))[:, None] * (1 + cells / len(cells))
    upper = (2.0 ** -(levels + 1))[:, None] * (1 + (cells + 1) / len(cells))
    sizes = 2.0 ** (np.arange(48) / 2)
    p = np.exp(np.log1p(-lower.ravel())[None] * sizes[:, None]) - np.exp(np.log1p(-np.minimum(upper, 1 - 1e-12).ravel())[None] * sizes[:, None])
    return p @ p.T


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, without those equal by chance."""
    full = (a != 0xFFFF) | (b != 0xFFFF)
    equal = ((a == b) & full).sum(axis=1) / np.maximum(1, full.sum(axis=1))
    at = lambda n: np.clip(np.rint(2 * np.log2(np.maximum(1, n / (1 << BUCKET_BITS)))), 0, 47).astype(int)
    chance = _chance()[at(n_a), at(n_b)]
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def sketches(docs: DataFrame, width: int, min_tokens: int) -> DataFrame:
    """(doc_id, n, sketch BINARY, bands ARRAY<BIGINT>) of the documents of at least min_tokens tokens."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHasher()
        for batch in batches(rows, 500):
            arrays = token_arrays(batch.column(1).to_pylist(), hasher)
            keep = [k for k, a in enumerate(arrays) if len(a) >= max(min_tokens, width)]
            grams = [np.unique(shingles(arrays[k], width)) for k in keep]
            if not keep:
                continue
            sizes = np.array(list(map(len, grams)))
            r = registers(np.concatenate(grams), np.repeat(np.arange(len(keep)), sizes), len(keep))
            by_band = r[:, : r.shape[1] // ROWS_PER_BAND * ROWS_PER_BAND].reshape(len(keep), -1, ROWS_PER_BAND).astype(np.uint64)
            keys = mix(np.broadcast_to(np.arange(by_band.shape[1], dtype=np.uint64), by_band.shape[:2]).copy(), 7)
            for k in range(ROWS_PER_BAND):
                keys = mix(keys ^ by_band[:, :, k], 20 + k)
            some = (by_band != 0xFFFF).any(axis=2)
            ends = np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array(sizes, pa.int32()),
                    pa.array([x.tobytes() for x in r[:, :ESTIMATE]], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].view(np.int64))),
                ],
                names=["doc_id", "n", "sketch", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n int, sketch binary, bands array<bigint>")


def hot_bands(banded: DataFrame, limit: int = HOT_BAND) -> DataFrame:
    """(band): those that about `limit` documents or more have, from the counts of one document in HOT_SAMPLE.

    This only chooses between two ways of finding the same pairs, so a band near the limit may fall on either side.
    """
    some = banded.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    return some.groupBy("band").count().where(F.col("count") >= max(2, limit // HOT_SAMPLE)).select("band")


def rare_gram_pairs(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) with a < b: all pairs that can have the similarity, by their rarest grams.

    A pair of Jaccard similarity s shares at least s of either set, so the two have one of the n - ceil(s n) + 1 rarest
    grams of each in common. What many documents share is frequent, and isn't looked up unless a set has little else.
    """
    grams = written(sorted_shingles(docs, width).select("doc_id", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "hot_grams")
    counts = grams.groupBy("gram").agg(F.count("*").alias("holders")).where("holders > 1")
    ranked = grams.join(counts, "gram", "left").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("holders", F.lit(1)), "gram")))
    rare = ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1) & F.col("holders").isNotNull()).select("gram", "doc_id")
    rare = written(rare, "rare_grams")
    return rare.select("gram", F.col("doc_id").alias("a")).join(rare.select("gram", F.col("doc_id").alias("b")), "gram").where("a < b").select("a", "b").distinct()


def candidates(sketched: DataFrame, docs: DataFrame, width: int, similarity: float, limit: int = HOT_BAND) -> DataFrame:
    """(a, b) with a < b: documents that agree in a band and whose estimate is not clearly below `similarity`.

    The documents of a band that very many have (of boilerplate) are compared by their rarest grams instead, exactly.
    """
    banded = sketched.select(F.explode("bands").alias("band"), "doc_id")
    hot = written(hot_bands(banded, limit), "hot_bands")
    cool = banded.join(hot, "band", "left_anti")
    crowded = written(banded.join(hot, "band", "left_semi").select("doc_id").distinct(), "crowded")
    pairs = cool.select("band", F.col("doc_id").alias("a")).join(cool.select("band", F.col("doc_id").alias("b")), "band").where("a < b").select("a", "b")
    pairs = pairs.unionByName(rare_gram_pairs(docs.join(crowded, "doc_id", "left_semi"), width, similarity)).distinct()
    least = similarity - 4.5 * float(np.sqrt(similarity * (1 - similarity) / ESTIMATE))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 4))
            ok = estimated(a, b, batch.column(3).to_numpy(), batch.column(5).to_numpy()) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    one = pairs.join(sketched.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("size_a")), "a")
    both = one.join(sketched.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("size_b")), "b")
    return both.select("a", "b", "sketch_a", "size_a", "sketch_b", "size_b").mapInArrow(run, "a bigint, b bigint")


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, min_tokens: int = 0, without: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, jaccard) between representatives of different texts, and members (rep, doc_id, copies).

    docs has doc_id and text; `without` (doc_id) is left out.
    """
    once, members = classes(docs, max(1, min_tokens), without)
    once = written(once, "records")  # read for the sketches and for the exact count
    sketched = written(sketches(once, width, min_tokens), "sketches")
    near = written(candidates(sketched, once, width, similarity), "candidates")
    dropped(sketched)
    exact = with_shared(near, once, width)
    links = exact.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).where(F.col("jaccard") >= similarity)
    links = written(links.select("a", "b", "jaccard"), "links")
    dropped(once, near)
    return links, members


def near_duplicate_pairs(docs: DataFrame, width: int = 5, similarity: float = 0.8, min_tokens: int = 0, without: DataFrame | None = None) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: pairs of similar or equal texts; see copies.expand for very large groups of copies."""
    links, members = similar_classes(docs, width, similarity, min_tokens, without)
    own = members.where("copies > 1 AND doc_id = rep").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    pairs = expand(links.select("a", "b").unionByName(own), members)
    return pairs.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, min_tokens: int = 0, without: DataFrame | None = None) -> DataFrame:
    """(doc_id, group_id, class_id, n_links): a row for each document in a group of two or more.

    group_id is the smallest class of the connected group, class_id the smallest doc_id with the same text, n_links the
    number of other texts that this one is similar to.
    """
    links, members = similar_classes(docs, width, similarity, min_tokens, without)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = components(links).withColumnsRenamed({"node": "rep", "component": "group_id"})
    full = members.join(named, "rep", "left").join(ends, "rep", "left")
    return full.where("copies > 1 OR group_id IS NOT NULL").select("doc_id", F.coalesce("group_id", "rep").alias("group_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
