"""Label functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import MBTI_TYPES, strip

# Traits and the names of the four axes.
TRAITS = ("O", "C", "E", "A", "N")
TRAIT_NAMES = {"O": "openness", "C": "conscientiousness", "E": "extraversion", "A": "agreeableness", "N": "neuroticism"}
AXES = (("IE", 1), ("SN", 2), ("TF", 3), ("JP", 4))
CATEGORIES = (
    "trait_definition",
    "facet_definition",
    "state_definition",
    "behavioral_marker",
    "linguistic_correlate",
    "evidence_mapping_example",
    "type_description",
    "cognitive_function",
    "few_shot_example",
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mbti(c: Column | str) -> Column:
    """The type in capitals, null unless it is one of the sixteen."""
    up = F.upper(strip(c))
    return F.when(up.isin(*MBTI_TYPES), up)


def mbti_axes(c: Column | str) -> Column:
    """Map of axis to letter; empty unless the type has four letters."""
    up = F.upper(strip(c))
    pairs = F.create_map(*(x for axis, k in AXES for x in (F.lit(axis), F.substring(up, k, 1))))
    return F.when(F.length(up) == 4, pairs).otherwise(F.expr("cast(map() as map<string,string>)"))


def assembled_type(axes: Column, default: str = "INTP") -> Column:
    """The type that a map of axis to letter makes; a letter that is missing or not of its axis is that of `default`."""
    own = {axis: F.element_at(axes, F.lit(axis)) for axis, _ in AXES}
    return F.concat(*(F.when(own[axis].isin(*axis), own[axis]).otherwise(default[k - 1]) for axis, k in AXES))


def inferred_trait(trait: Column | str, signals: Column) -> Column:
    """The trait, else the first of the five that is the first letter of a signal; null without any."""
    letters = F.filter(F.transform(signals, lambda s: F.upper(F.substring(s, 1, 1))), lambda c: c.isin(*TRAITS))
    up = F.upper(_c(trait))
    return F.when(up.isin(*TRAITS), up).otherwise(F.get(letters, F.lit(0)))


def prior_label(levels: dict[str, Column]) -> Column:
    """O:HIGH,C:LOW,... ; null where a trait is missing."""
    return F.concat(*(x for k, t in enumerate(TRAITS) for x in (F.lit(f"{',' * (k > 0)}{t}:"), levels[t])))


def yes_no_level(c: Column | str) -> Column:
    return F.when(F.lower(_c(c)) == "y", "HIGH").otherwise("LOW")


def percent_level(c: Column | str) -> Column:
    return F.when(_c(c).isNull(), None).when(_c(c) > 50, "HIGH").otherwise("LOW")


def level(c: Column | str) -> Column:
    """HIGH, LOW or UNKNOWN from a level in English or Chinese; high is tested first."""
    low = F.lower(_c(c))
    return F.when(low.rlike("high|高"), "HIGH").when(low.rlike("low|低"), "LOW").otherwise("UNKNOWN")


def pole(c: Column | str) -> Column:
    up = F.upper(strip(c))
    return F.when(up.isin("HIGH", "H", "+", "POSITIVE"), "HIGH").when(up.isin("LOW", "L", "-", "NEGATIVE"), "LOW").when(up.isin("BOTH", "DEFINITION", "NEUTRAL", "MIXED"), "BOTH").otherwise(up)


def margin_confidence(margin: Column | str) -> Column:
    return 1 / (1 + F.exp(-F.abs(_c(margin))))


def trait_string(levels: dict[str, Column]) -> Column:
    """O:HIGH,C:LOW,... of the traits that are present."""
    return F.concat_ws(",", *(F.concat(F.lit(f"{t}:"), levels[t]) for t in TRAITS))


def parse_trait_string(c: Column | str) -> Column:
    """Map of trait to level from O:HIGH,C:LOW,...; parts without a colon are dropped."""
    parts = F.filter(F.transform(F.split(_c(c), ","), lambda p: strip(p)), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.upper(strip(F.split_part(p, F.lit(":"), F.lit(1)))).alias("k"), F.upper(strip(F.split_part(p, F.lit(":"), F.lit(2)))).alias("v")))
    return F.map_from_entries(pairs)


def combo(levels: dict[str, Column]) -> Column:
    return F.concat(*(F.when(levels[t] == "HIGH", "1").when(levels[t] == "LOW", "0").otherwise("X") for t in TRAITS))


def percent(n: Column, d: Column) -> Column:
    """100 n / d to two places, 0 where d is 0."""
    return F.when(d == 0, 0.0).otherwise(F.round(100.0 * n / d, 2))


def record_id(source: str, content: Column | str) -> Column:
    return F.concat(F.lit(source + "_"), F.substring(F.md5(_c(content)), 1, 8))


def validation_errors(c: dict[str, Column]) -> Column:
    """The faults of a chunk: c has chunk_id, text, framework, category, source_id, lang, tier, trait and pole."""
    blank = lambda x: x.isNull() | (x == "")
    tests = [
        (blank(c["chunk_id"]), F.lit("missing chunk_id")),
        (c["text"].isNull() | (strip(c["text"]) == ""), F.lit("missing text")),
        *((blank(c[k]), F.lit(f"missing metadata.{name}")) for k, name in (("framework", "framework"), ("category", "category"), ("source_id", "source_id"), ("tier", "quality_tier"), ("lang", "language"))),
        (~F.coalesce(c["category"].isin(*CATEGORIES), F.lit(False)), F.concat(F.lit("invalid category: "), F.coalesce(c["category"], F.lit("None")))),
        (~F.coalesce(c["tier"].isin("A", "B", "C"), F.lit(False)), F.concat(F.lit("invalid quality_tier: "), F.coalesce(c["tier"], F.lit("None")))),
        (
            (c["framework"] == "ocean") & ~F.coalesce(c["category"].isin("evidence_mapping_example", "few_shot_example"), F.lit(False)) & ~F.coalesce(c["trait"].isin(*TRAITS), F.lit(False)),
            F.lit("ocean chunk missing valid trait"),
        ),
        (~blank(c["pole"]) & ~c["pole"].isin("HIGH", "LOW", "BOTH"), F.concat(F.lit("invalid pole: "), c["pole"])),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), text) for test, text in tests)), lambda e: e.isNotNull())
