"""The three steps from text to a labelled prediction, with a pluggable client that answers prompts.

Each step is a DataFrame stage: prompts are built by expressions, answers come from `answer`, a column function (the
deterministic rule client, inside the JVM) or a client called in Arrow batches, and are read by JSON expressions.
A reply that can't be read gives UNKNOWN and never drops the row.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomtext.functions import labels as L
from loomtext.functions import replies
from loomtext.functions import text as X
from loomtext.operators.evidence import scored_sentences, top_sentences


class Client(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


def client_answers(client: Client, prompt: Column, retries: int = 2, pause: float = 0.0) -> Column:
    """Answers of a client, asked batch by batch in the tasks; a failing call is repeated after pause * 2**k seconds."""

    @F.pandas_udf(StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            for k in range(retries + 1):
                try:
                    yield pd.Series(client.generate(list(prompts)), dtype=object)
                    break
                except (OSError, ValueError):
                    if k == retries:
                        yield pd.Series([None] * len(prompts), dtype=object)
                    else:
                        time.sleep(pause * 2**k)

    return ask(prompt)


EVIDENCE = "struct<quote:string,sentence_idx:int,behavior_type:string>"
#: Words by which the rule client tells a level of a trait.
RULES = {"O": ("curious", "playful"), "C": ("orderliness", "planning"), "E": ("people", "parties"), "A": ("comforting", "others"), "N": ("anxious", "uneasy")}


def rule_evidence(docs: DataFrame, lexicon: tuple[str, ...], k: int = 5) -> DataFrame:
    """(doc_id, reply): step 1 of the rule client, a JSON list of the best sentences in a code fence."""
    top = top_sentences(scored_sentences(docs, lexicon).where("score > 0"), k)
    item = F.struct(F.col("rank"), F.struct(F.col("sentence").alias("quote"), F.col("sentence_idx").cast("int").alias("sentence_idx"), F.lit("general").alias("behavior_type")).alias("e"))
    listed = top.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["e"]).alias("all"))
    return listed.select("doc_id", F.concat(F.lit("```json\n"), F.to_json("all"), F.lit("\n```")).alias("reply"))


def read_evidence(answered: DataFrame) -> DataFrame:
    """(doc_id, evidence): objects with a quote; the behaviour is general where it is missing."""
    read = replies.salvaged(answered, "reply", EVIDENCE, "items")
    items = F.filter("items", lambda e: F.coalesce(e["quote"], F.lit("")) != "")
    whole = F.transform(items, lambda e: F.struct(e["quote"].alias("quote"), e["sentence_idx"].alias("sentence_idx"), F.coalesce(e["behavior_type"], F.lit("general")).alias("behavior_type")))
    return read.select("doc_id", whole.alias("evidence"))


def states(evidence: DataFrame) -> DataFrame:
    """(doc_id, evidence, states): step 2, the traits whose words the quotes hold; no evidence gives no states."""
    said = F.array_distinct(F.flatten(F.transform("evidence", lambda e: X.tokens(e["quote"]))))
    found = F.filter(F.array(*(F.when(F.arrays_overlap(said, F.array(*map(F.lit, words))), t) for t, words in RULES.items())), lambda t: t.isNotNull())
    return evidence.withColumn("states", found)


def predict(docs: DataFrame, staged: DataFrame, prior: Column | None = None) -> DataFrame:
    """(doc_id, n_evidence, predicted): step 3; without states the prior decides, without a prior UNKNOWN."""
    joined = docs.select("doc_id", *([prior.alias("_prior")] if prior is not None else [F.lit(None).cast("string").alias("_prior")])).join(staged, "doc_id", "left")
    some = F.coalesce(F.size("states") > 0, F.lit(False))
    label = L.trait_string({t: F.when(F.array_contains("states", t), "HIGH").otherwise("LOW") for t in L.TRAITS})
    return joined.select("doc_id", F.coalesce(F.greatest(F.size("evidence"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_evidence"), F.when(some, label).otherwise(F.coalesce("_prior", F.lit("UNKNOWN"))).alias("predicted"))
