"""Building of the knowledge base: chunking, metadata, embedding texts, vectors, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import text as X

# Provenance of the named sources; a source that isn't listed has that of project_seed.
REGISTRY = (
    ("neo_pi_r_costa_mccrae", "A", "citable_paraphrase"),
    ("costa_mccrae_1992", "A", "citable_paraphrase"),
    ("bfi2_soto_john", "A", "citable_paraphrase"),
    ("big_five_inventory_john", "A", "citable_paraphrase"),
    ("goldberg_ipip", "A", "open_access"),
    ("apa_dictionary_psychology", "B", "citable_paraphrase"),
    ("mairesse_2007_linguistic_cues", "A", "citable_paraphrase"),
    ("yarkoni_2010_100k_words", "A", "citable_paraphrase"),
    ("schwartz_2013_social_media", "A", "citable_paraphrase"),
    ("park_2015_automatic_personality", "A", "citable_paraphrase"),
    ("pennebaker_king_1999", "A", "citable_paraphrase"),
    ("tausczik_pennebaker_2010_liwc", "A", "citable_paraphrase"),
    ("watson_clark_1984_negative_affectivity", "A", "citable_paraphrase"),
    ("mcadams_life_story_2006", "A", "citable_paraphrase"),
    ("carver_scheier_self_regulation", "B", "citable_paraphrase"),
    ("gross_emotion_regulation_2002", "A", "citable_paraphrase"),
    ("personality_evd_task_definition", "A", "citable_paraphrase"),
    ("personality_evd_trainval_evidence", "A", "project_seed"),
    ("whole_trait_theory_fleeson_2015", "A", "citable_paraphrase"),
    ("bfi2_paraphrased_item_anchors", "A", "citable_paraphrase"),
    ("gifts_differing_myers", "B", "citable_paraphrase"),
    ("myersbriggs_foundation", "B", "citable_paraphrase"),
    ("keirsey_temperament", "C", "project_seed"),
    ("jung_psychological_types", "B", "citable_paraphrase"),
    ("beebe_function_model", "C", "project_seed"),
    ("synthetic_textbook_example", "C", "project_seed"),
    ("project_seed", "C", "project_seed"),
)
DEFAULT_SOURCE = REGISTRY[-1]


def packed(df: DataFrame, text: Column, size: int | Column, overlap: int | Column = 0, least: int | Column = 1, mark: str = r"\n\n+", into: str = "_parts") -> DataFrame:
    """df with `into`: paragraphs packed into chunks of at most `size` words; a single longer paragraph is never cut.

    A finished chunk of fewer than `least` words is dropped. The next chunk begins with the share overlap / size of the
    words of the last one; an overlap of 0 repeats nothing. Null gives null.

    Paragraphs become lists of words once. A pass over their lengths gives each chunk's first and last paragraph and how
    many words it repeats; only then are texts put together, so the work grows with the text, not with its square. The
    steps are columns of their own, so that each is computed once for a row.
    """
    size, overlap, least = (c if isinstance(c, Column) else F.lit(c) for c in (size, overlap, least))
    df = df.withColumn("_paras", F.transform(F.split(text, mark), lambda p: F.struct(p.alias("t"), F.size(X.words(p)).alias("n"))))
    paras = F.col("_paras")
    mark_ = "struct<first:int,last:int,back:int,words:int>"
    kind = f"struct<done:array<{mark_}>,first:int,k:int,back:int,words:int,some:boolean>"

    def close(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), (acc["k"] - 1).alias("last"), acc["back"].alias("back"), acc["words"].alias("words"))))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["words"] + p["n"] > size) & acc["some"]
        back = F.floor(overlap * acc["words"] / size).cast("int")
        return F.struct(
            F.when(full, close(acc)).otherwise(acc["done"]).alias("done"),
            F.when(full, acc["k"]).otherwise(acc["first"]).alias("first"),
            (acc["k"] + 1).alias("k"),
            F.when(full, back).otherwise(acc["back"]).alias("back"),
            F.when(full, back + p["n"]).otherwise(acc["words"] + p["n"]).cast("int").alias("words"),
            (F.when(full, back > 0).otherwise(acc["some"]) | (p["t"] != "")).alias("some"),
        )

    start = F.expr(f"cast(struct(cast(array() as array<{mark_}>) as done, 0 as first, 0 as k, 0 as back, 0 as words, false as some) as {kind})")
    spans = F.aggregate(paras, start, step, lambda acc: F.when(acc["some"], close(acc)).otherwise(acc["done"]))
    body = lambda s: F.array_join(F.transform(F.slice(paras, s["first"] + 1, s["last"] - s["first"] + 1), lambda p: p["t"]), "\n\n")

    def with_tail(s: Column) -> Column:
        """The chunk's own paragraphs behind the words that it repeats, which may reach back over several chunks."""
        said = F.filter(F.slice(paras, 1, s["first"]), lambda p: p["n"] > 0)
        own = X.words(F.array_join(F.transform(F.slice(said, F.greatest(F.size(said) - s["back"] + 1, F.lit(1)), F.greatest(s["back"], F.lit(1))), lambda p: p["t"]), " "))
        tail = F.array_join(F.slice(own, F.greatest(F.size(own) - s["back"] + 1, F.lit(1)), F.greatest(s["back"], F.lit(1))), " ")
        return F.struct(X.strip(F.concat(F.when(s["back"] > 0, F.concat(tail, F.lit(" "))).otherwise(""), body(s))).alias("t"), s["words"].alias("n"))

    df = df.withColumn("_spans", F.filter(spans, lambda c: c["words"] >= least))
    return df.withColumn(into, F.transform("_spans", lambda s: with_tail(s)["t"])).drop("_paras", "_spans")


def chunked(sources: DataFrame, size: int, overlap: int = 0, least: int = 1, id_col: str = "chunk_id", text_col: str = "text", mark: str = r"\n\n+") -> DataFrame:
    """sources with one row for each chunk; <id>_c<k> and subchunk_index where a text gives several."""
    return _exploded(packed(sources.where(F.col(text_col).isNotNull()), F.col(text_col), size, overlap, least, mark), id_col, text_col)


def _exploded(parts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    each = parts.select("*", F.posexplode("_parts").alias("_k", "_part"))
    many = F.size("_parts") > 1
    named = F.when(many, F.concat(F.col(id_col).cast("string"), F.lit("_c"), F.col("_k"))).otherwise(F.col(id_col).cast("string"))
    return each.withColumns({id_col: named, text_col: F.col("_part"), "subchunk_index": F.when(many, F.col("_k").cast("bigint"))}).drop("_parts", "_k", "_part")


#: Words up to which a text stays whole, size of chunks, overlap and least size, by category.
SETTINGS = {
    "default": (160, 160, 20, 5),
    "evidence_mapping_example": (320, 320, 0, 5),
    "few_shot_example": (320, 320, 0, 5),
}


def with_settings(sources: DataFrame, settings: dict[str, tuple[int, int, int, int]] | None = None, legacy: tuple[int, int] | None = None) -> DataFrame:
    """sources (category, ...) with `setting`: that of the category, else the default.

    A legacy (size, overlap) for all categories goes before both and keeps nothing whole.
    """
    known = {"default": (0, legacy[0], legacy[1], 1)} if legacy else SETTINGS | (settings or {})
    names = ("atomic_words", "size", "overlap", "least")
    as_struct = lambda v: F.struct(*(F.lit(x).alias(n) for n, x in zip(names, v, strict=True)))
    chosen = as_struct(known["default"])
    for category, values in known.items():
        if category != "default":
            chosen = F.when(F.col("category") == category, as_struct(values)).otherwise(chosen)
    return sources.withColumn("setting", chosen)


def chunked_by_category(sources: DataFrame, settings: dict[str, tuple[int, int, int, int]] | None = None, legacy: tuple[int, int] | None = None) -> DataFrame:
    """sources (chunk_id, text, category) in chunks under the settings of their category; a short text is one chunk."""
    set_ = with_settings(sources.where("text IS NOT NULL"), settings, legacy).withColumn("whole", X.word_count("text") <= F.col("setting.atomic_words"))
    # a text that stays whole has no paragraphs to pack
    cut = packed(set_, F.when(~F.col("whole"), F.col("text")), F.col("setting.size"), F.col("setting.overlap"), F.col("setting.least"))
    return _exploded(cut.withColumn("_parts", F.when(F.col("whole"), F.array(X.strip("text"))).otherwise(F.col("_parts"))).drop("setting", "whole"), "chunk_id", "text")


def markdown_chunks(files: DataFrame, category: str, framework: str = "both") -> DataFrame:
    """(chunk_id, text, category, framework) from (path, text) of whole markdown or plain files, one row for each file."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.where(X.strip("text") != "").select(X.safe_name(name).alias("chunk_id"), "text", F.lit(category).alias("category"), F.lit(framework).alias("framework"))


def step_blocks(text: Column) -> Column:
    """Blocks of a worked example: everything before step 2 first, then each later step."""
    return F.filter(F.transform(F.split(text, r"(?m)^(?=## STEP [23])"), X.strip), lambda b: b != "")


def registry(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(REGISTRY), "source_id string, tier string, license string")


def normalized(chunks: DataFrame) -> DataFrame:
    """chunks with defaults and spellings settled: source_id, tier, license, framework, category, lang, trait and pole."""
    filled = chunks.withColumns(
        {
            "source_id": F.coalesce(F.nullif("source_id", F.lit("")), F.lit(DEFAULT_SOURCE[0])),
            "framework": F.lower(F.coalesce(F.nullif("framework", F.lit("")), F.lit("both"))),
            "category": F.coalesce(F.nullif("category", F.lit("")), F.lit("behavioral_marker")),
            "lang": F.coalesce(F.nullif("lang", F.lit("")), F.lit("en")),
            "trait": F.when(F.upper("trait").isin(*L.TRAITS), F.upper("trait")).otherwise(F.col("trait")),
            "pole": L.pole("pole"),
        }
    )
    known = filled.join(F.broadcast(registry(chunks)), "source_id", "left")  # a fixed list
    return known.withColumns({"tier": F.coalesce("tier", F.lit(DEFAULT_SOURCE[1])), "license": F.coalesce("license", F.lit(DEFAULT_SOURCE[2]))})


def embed_text(c: dict[str, Column]) -> Column:
    """The text that is embedded: a lead that names what the chunk is about, then the text.

    c has text, category, framework, trait, pole, facet and source_id.
    """
    up = F.upper(c["framework"])
    sign = F.when(c["pole"] == "HIGH", "+").when(c["pole"] == "LOW", "-").otherwise("")
    signal = F.coalesce(F.concat(c["trait"], sign), F.lit("unspecified"))
    trait = F.coalesce(c["trait"], F.lit("unspecified"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    lead = (
        F.when(c["category"] == "state_definition", say("State: UnlabeledState. Trait signals: ", signal, ". Definition:"))
        .when(c["category"] == "behavioral_marker", say("Behavioral marker. Framework: ", up, ". Trait: ", signal, "."))
        .when(c["category"] == "linguistic_correlate", say("Linguistic correlate. Framework: ", up, ". Trait: ", signal, "."))
        .when(c["category"] == "trait_definition", say("Trait definition. Framework: ", up, ". Trait: ", trait, "."))
        .when(c["category"] == "facet_definition", say("Facet definition. Trait: ", trait, ". Facet: ", F.coalesce(c["facet"], F.lit("unspecified")), ". Pole: ", F.coalesce(c["pole"], F.lit("BOTH")), "."))
        .when(c["category"] == "type_description", say("Type description. Framework: ", up, ". Type: unspecified."))
        .when(c["category"] == "cognitive_function", say("Cognitive function. Type: unspecified. Function: unspecified."))
        .when(c["category"] == "evidence_mapping_example", say("Evidence mapping. Framework: ", up, ". Trait: ", trait, " ", F.coalesce(c["pole"], F.lit("BOTH")), ". Source: ", c["source_id"], "."))
        .when(c["category"] == "few_shot_example", say("Few-shot example. Framework: ", up, ". Target: unspecified. Example: unspecified."))
        .otherwise(say("Knowledge chunk. Framework: ", up, ". Category: ", c["category"], "."))
    )
    return X.strip(F.concat(lead, F.lit(" "), X.strip(c["text"])))


def hashed_vector(text: Column, size: int = 64) -> Column:
    """An L2-normed vector of hashed token counts: the offline stand-in for a sentence encoder; null for no tokens."""
    # each token is hashed once; the lambdas see numbers only
    slots = F.transform(X.tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % size).cast("int"))
    count = lambda acc, slot: F.transform(acc, lambda v, k: F.when(k == slot, v + 1.0).otherwise(v))

    def unit(acc: Column) -> Column:
        norm = F.sqrt(F.aggregate(acc, F.lit(0.0), lambda a, v: a + v * v))
        return F.when(norm > 0, F.transform(acc, lambda v: v / norm))

    return F.aggregate(slots, F.array_repeat(F.lit(0.0), size), count, unit)


def repeated_ids(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return chunks.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def latest(points: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: of each key the row with the greatest order."""
    cols = [c for c in points.columns if c != key]
    return points.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*")
