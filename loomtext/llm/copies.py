"""Classes of equal texts, so that groups of copies enter joins once, and links and groups between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import TokenHasher, batches, mix, shingles, tokens
from loomtext.session import dropped, written

#: Two classes of copies with more pairs of members than this are linked through their representatives alone.
EXPAND_LIMIT = 10_000


def token_arrays(texts: list[str | None], hasher: TokenHasher) -> list[np.ndarray]:
    return [hasher(tokens(t)) if t else np.empty(0, np.uint64) for t in texts]


def _text_key(h: np.ndarray, seed: int) -> int:
    place = np.arange(len(h), dtype=np.uint64)
    return int(np.bitwise_xor.reduce(mix(h + place * np.uint64(0x9E3779B97F4A7C15), seed))) if len(h) else 0


def text_keys(docs: DataFrame, min_tokens: int) -> DataFrame:
    """docs with k1 and k2 in place of text, of the rows of at least min_tokens tokens; equal keys mean equal token sequences."""
    kept = [c for c in docs.columns if c != "text"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHasher()
        for batch in batches(rows):
            arrays = token_arrays(batch.column("text").to_pylist(), hasher)
            keep = [k for k, a in enumerate(arrays) if len(a) >= min_tokens]
            keys = [np.array([_text_key(arrays[k], seed) for k in keep], np.uint64).view(np.int64) for seed in (11, 12)]
            rest = [batch.column(c).take(pa.array(keep, pa.int64())) for c in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(keys[0]), pa.array(keys[1])], names=[*kept, "k1", "k2"])

    return docs.mapInArrow(run, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept) + ", k1 bigint, k2 bigint")


def classes(docs: DataFrame, min_tokens: int, without: DataFrame | None = None, apart: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, text, *apart) of one record of each class of equal texts, and members (rep, doc_id, copies, *apart).

    Texts with different values of the columns `apart` are in different classes. Of several rows of one doc_id the one
    counts whose text comes first by its hash, whatever the order of the rows. Texts are moved once.
    """
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", *apart).withColumn("h", F.xxhash64("text", *apart))
    keyed = text_keys(docs.select("doc_id", "h", *apart, "text"), min_tokens)
    if without is not None:
        keyed = keyed.join(without.select("doc_id"), "doc_id", "left_anti")
    chosen = keyed.groupBy("doc_id").agg(F.min(F.struct("h", "k1", "k2", *apart)).alias("row")).select("doc_id", "row.*")
    chosen = written(chosen, "keys")
    reps = chosen.groupBy("k1", "k2", *apart).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = written(chosen.join(reps, ["k1", "k2", *apart]).select("rep", "doc_id", "h", "copies", *apart), "members")
    once = docs.join(members.where("doc_id = rep").select("doc_id", "h"), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return once.drop("h"), members.drop("h")


def sorted_shingles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, grams ARRAY<BIGINT>): the distinct hashes of each document's runs of `width` tokens."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHasher()
        for batch in batches(rows, 500):
            grams = [np.unique(shingles(a, width)).view(np.int64) for a in token_arrays(batch.column(1).to_pylist(), hasher)]
            ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            flat = np.concatenate(grams) if grams else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], names=["doc_id", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, grams array<bigint>")


def with_shared(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """pairs (a, b, ...) with n_a, n_b and shared: the exact numbers of distinct grams of both and in common."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    grams = sorted_shingles(docs.join(needed, "doc_id", "left_semi"), width)
    one = pairs.join(grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a")), "a")
    both = one.join(grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b")), "b")
    return both.withColumns({"n_a": F.size("grams_a"), "n_b": F.size("grams_b"), "shared": F.size(F.array_intersect("grams_a", "grams_b"))}).drop("grams_a", "grams_b")


def expand(pairs: DataFrame, members: DataFrame, limit: int = EXPAND_LIMIT) -> DataFrame:
    """Document pairs (x, y) from class pairs (a, b) and members (rep, doc_id, copies).

    All members of the two classes are paired. Only where that would be more than `limit` pairs, each member is paired
    with the other class's representative: membership gives the rest, and no link between different texts is lost.
    """
    left = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"), F.col("copies").alias("copies_a"))
    right = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"), F.col("copies").alias("copies_b"))
    sized = (
        pairs.select("a", "b")
        .join(members.where("doc_id = rep").select(F.col("rep").alias("a"), F.col("copies").alias("copies_a")), "a")
        .join(members.where("doc_id = rep").select(F.col("rep").alias("b"), F.col("copies").alias("copies_b")), "b")
        .withColumn("small", F.col("copies_a") * F.col("copies_b") <= limit)
        .select("a", "b", "small")
    )
    small = sized.where("small").join(left, "a").join(right, "b").select("x", "y")
    large = sized.where("NOT small")
    stars = large.join(left, "a").select("x", F.col("b").alias("y")).unionByName(large.join(right, "b").select(F.col("a").alias("x"), "y"))
    return small.unionByName(stars.distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): connected components of edges (a, b), named by their smallest node.

    Alternating large and small stars; minima are pre-aggregated and joined back, so no neighbourhood is collected.
    """

    def star(e: DataFrame, keep: str) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return e.join(least, "u").where(keep).select(F.col("v").alias("x"), "m")

    both: Callable[[DataFrame], DataFrame] = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        large = star(both(now), "v > u").where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        # small star: each node with its smaller neighbours, all linked to the least of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").select("m", F.col("v").alias("x")).unionByName(least.select("m", F.col("u").alias("x")))
        last, now = now, written(linked.where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "edges")
        dropped(last)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(row):
            break
        state = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
