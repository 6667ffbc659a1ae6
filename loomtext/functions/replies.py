"""JSON out of free replies, as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import strip


def extract_json(c: Column) -> Column:
    """The JSON text of a reply: without fences, from the first bracket to the last that closes its kind.

    A reply without brackets comes back trimmed.
    """
    bare = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    found = F.regexp_extract(bare, r"(?s)^[^{\[]*(\{.*\}|\[.*\])", 1)
    return F.when(found != "", found).otherwise(bare)


def salvaged(df: DataFrame, reply: str, schema: str, into: str) -> DataFrame:
    """df with `into`: the objects of a reply, those of its list, else each {...} that parses; an empty array for none.

    Step by step, so that each part is read once.
    """
    ok = lambda a: F.filter(a, lambda x: x.isNotNull())
    empty = F.expr(f"cast(array() as array<{schema}>)")
    read = df.withColumn("_json", extract_json(F.col(reply)))
    listed = read.withColumn("_list", F.when(F.startswith("_json", F.lit("[")), ok(F.from_json("_json", f"array<{schema}>"))))
    single = ok(F.transform(F.regexp_extract_all(F.col(reply), F.lit(r"(?s)\{.*?\}"), F.lit(0)), lambda s: F.from_json(s, schema)))
    return listed.withColumn(into, F.when(F.size("_list") > 0, F.col("_list")).otherwise(F.coalesce(single, empty))).drop("_json", "_list")


def first_object(c: Column, schema: str) -> Column:
    """The object between the first { and the last } of a reply; its fields are null where it can't be read."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)


def strings_of(c: Column) -> Column:
    """All strings of a JSON text at any depth, values not keys, in order; null for null and for text that isn't JSON."""

    @F.pandas_udf("array<string>")
    def collect(texts: pd.Series) -> pd.Series:
        def walk(x: object) -> Iterator[str]:
            if isinstance(x, str):
                yield x
            elif isinstance(x, (dict, list)):
                for y in x.values() if isinstance(x, dict) else x:
                    yield from walk(y)

        def one(text: str | None) -> list[str] | None:
            try:
                return None if text is None else list(walk(json.loads(text)))
            except ValueError:
                return None

        return texts.map(one)

    return collect(c)
