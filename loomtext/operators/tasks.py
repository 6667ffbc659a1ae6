"""Labels projected to tasks, and the rows of records that tasks, profiles and knowledge bases are made of.

A task row is (id, task, label) of a text that isn't blank; a null or unknown label gives no row. Repeated rows give
repeated results unless a key is named; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import text as X

#: Tasks of a corpus with types, and of one with traits.
TYPE_TASKS = ("16class", *(axis for axis, _ in L.AXES))
TRAIT_TASKS = tuple(f"ocean_{t}" for t in L.TRAITS)


def task_names(dataset: str, task: str) -> list[str]:
    """The single tasks that a task of a dataset stands for; suffixes of variants don't matter.

    A dataset of types has 16class and 4dim, one of traits ocean_binary; `all` is every one. Others raise ValueError.
    """
    base = dataset.removesuffix("_augmented").removesuffix("_uncleaned")
    groups = {"16class": TYPE_TASKS[:1], "4dim": TYPE_TASKS[1:]} if base in ("mbti", "pandora") else {"ocean_binary": TRAIT_TASKS}
    if task == "all":
        return [t for group in groups.values() for t in group]
    if task in groups:
        return list(groups[task])
    if any(task in group for group in groups.values()):
        return [task]
    raise ValueError(f"unknown task {task} of {dataset}")


def type_rows(df: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """(id, task, label) for the type and for each of its four axes."""
    own = L.mbti(label)
    tasks = F.map_concat(F.create_map(F.lit(TYPE_TASKS[0]), own), L.mbti_axes(own))
    return df.where(own.isNotNull() & (X.strip(text) != "")).select(id_col, F.explode(tasks).alias("task", "label"))


def trait_rows(df: DataFrame, id_col: str, text: str, levels: dict[str, Column]) -> DataFrame:
    """(id, task, label) for each trait that is HIGH or LOW."""
    pairs = F.create_map(*(x for t in L.TRAITS for x in (F.lit(f"ocean_{t}"), levels[t])))
    return df.where(X.strip(text) != "").select(id_col, F.explode(pairs).alias("task", "label")).where("label IN ('HIGH', 'LOW')")


def task_data(rows: DataFrame, dataset: str, task: str) -> DataFrame:
    return rows.where(F.col("task").isin(task_names(dataset, task)))


def speaker_labels(evidence: DataFrame) -> DataFrame:
    """(dialogue_id, speaker, O..N, signature, complete): the five traits' levels of each speaker.

    Of several levels of a trait HIGH goes before LOW and LOW before UNKNOWN; a missing trait is UNKNOWN and makes the
    signature null; complete tells whether all five are HIGH or LOW.
    """
    level = L.level("level_raw")
    per = evidence.groupBy("dialogue_id", "speaker").agg(*(F.min(F.when(F.col("trait") == t, level)).alias(t) for t in L.TRAITS))
    signature = F.concat(*(x for t in L.TRAITS for x in (F.lit("|"), F.col(t))))
    complete = F.lit(True)
    for t in L.TRAITS:
        complete = complete & F.coalesce(F.col(t).isin("HIGH", "LOW"), F.lit(False))
    return per.select("dialogue_id", "speaker", *(F.coalesce(t, F.lit("UNKNOWN")).alias(t) for t in L.TRAITS), F.substring(signature, 2, 100).alias("signature"), complete.alias("complete"))


def labelled_speakers(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """records (dialogue_id, speaker, ...) with the speaker's levels, UNKNOWN without any, and the number of evidence rows."""
    counts = evidence.groupBy("dialogue_id", "speaker").agg(F.count("*").alias("n_evidence"))
    joined = records.join(speaker_labels(evidence), ["dialogue_id", "speaker"], "left").join(counts, ["dialogue_id", "speaker"], "left")
    return joined.withColumns({t: F.coalesce(t, F.lit("UNKNOWN")) for t in L.TRAITS} | {"n_evidence": F.coalesce("n_evidence", F.lit(0))})


def disagreement(evidence: DataFrame) -> DataFrame:
    """(trait, n, n_disagree, share): evidence whose level isn't that of its speaker's label; levels UNKNOWN are left out."""
    labels = speaker_labels(evidence).select("dialogue_id", "speaker", F.explode(F.create_map(*(x for t in L.TRAITS for x in (F.lit(t), F.col(t))))).alias("trait", "label"))
    each = evidence.select("dialogue_id", "speaker", "trait", L.level("level_raw").alias("level")).where("level <> 'UNKNOWN'")
    other = F.count_if(F.col("level") != F.col("label"))
    return each.join(labels, ["dialogue_id", "speaker", "trait"]).groupBy("trait").agg(F.count("*").alias("n"), other.alias("n_disagree"), F.round(other / F.count("*"), 6).alias("share"))


def split_suffix(stem: Column | str) -> Column:
    """(base, split) of a name that ends in _train, _eval or _test; without such an end the split is test."""
    c = F.col(stem) if isinstance(stem, str) else stem
    found = F.regexp_extract(c, "^(.*)_(train|eval|test)$", 2)
    return F.struct(F.when(found != "", F.regexp_extract(c, "^(.*)_(train|eval|test)$", 1)).otherwise(c).alias("base"), F.when(found != "", found).otherwise("test").alias("split"))


def flagged(df: DataFrame, flags: dict[str, Column], key: str, each: int) -> DataFrame:
    """(flag, key): at most `each` examples of every flag, those whose key's MD5 comes first; limited before the shuffle too."""
    hit = df.select(F.col(key), F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())), lambda x: x.isNotNull())).alias("flag"))
    w = Window.partitionBy("flag").orderBy(F.md5(F.col(key).cast("string")), key)
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).select("flag", key)


def bags(df: DataFrame, key: str, count: int = 10, share: float = 0.8) -> DataFrame:
    """df with `bag`: each row in about `share` of `count` bags, by the MD5 of bag and key; rows stay where they are."""
    every = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", "bag", F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return every.where(drawn < int(share * (1 << 32)))


def mapping_chunks(evidence: DataFrame, held_out: Column, each: int) -> DataFrame:
    """(chunk_id, text, trait, pole, mapping): worked examples for the knowledge base from evidence rows.

    Rows of held-out dialogues feed nothing, and a quote that a held-out dialogue has too is left out. Of each trait
    and level at most `each` rows are taken, those whose MD5 comes first. An undetermined level gives a text that says
    to abstain, of pole BOTH.
    """
    rows = evidence.where("trait IS NOT NULL AND nat_lang IS NOT NULL").select("dialogue_id", "speaker", "trait", L.level("level_raw").alias("level"), X.strip("nat_lang").alias("quote"), held_out.alias("held_out"))
    leaked = rows.where("held_out").select("quote").distinct()
    safe = rows.where("NOT held_out").drop("held_out").join(leaked, "quote", "left_anti").distinct()
    key = F.md5(F.concat_ws("|", "dialogue_id", F.coalesce("speaker", F.lit("")), "trait", "level", "quote"))
    w = Window.partitionBy("trait", "level").orderBy("key")
    chosen = safe.withColumn("key", key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each)
    name = F.element_at(F.create_map(*(F.lit(x) for pair in L.TRAIT_NAMES.items() for x in pair)), F.col("trait"))
    sure = F.format_string('The statement "%s" is evidence of %s %s.', F.col("quote"), F.col("level"), name)
    unsure = F.format_string('The statement "%s" does not settle %s; abstain.', F.col("quote"), name)
    known = F.col("level") != "UNKNOWN"
    return chosen.select(
        F.concat(F.lit("mapping_"), F.substring("key", 1, 12)).alias("chunk_id"),
        F.when(known, sure).otherwise(unsure).alias("text"),
        "trait",
        F.when(known, F.col("level")).otherwise("BOTH").alias("pole"),
        F.when(known, "evidence_mapping").otherwise("insufficient_evidence").alias("mapping"),
    )
