"""Readers of raw corpora and files, with explicit schemas, so that columns are pruned and types stable."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as X

RECORD = "id string, text string, label_mbti string, label_ocean struct<O:string,C:string,E:string,A:string,N:string>, source string, split string, metadata map<string,string>"
PREDICTION = "id string, text string, gold_label string, predicted_label string, latency_seconds double"
CHUNK = "chunk_id string, text string, embed_text string, metadata map<string,string>"


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON Lines; blank and malformed lines are dropped, a missing path raises."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL").drop("_bad")


def splits(spark: SparkSession, folder: str, schema: str = RECORD, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """All splits of a corpus in one scan, with split_file from the name of the file, or of the folder of part files."""
    rows = json_lines(spark, [f"{folder}/{n}.jsonl" for n in names], schema)
    return rows.withColumn("split_file", _stem())


def _stem() -> Column:
    """The name of the file, or of the folder of part files, that ends in .jsonl."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1)


def delimited(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, quotes doubled inside quotes and line ends in fields; empty fields are null."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', encoding=encoding).csv(path)


def essays(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, "authid string, text string, copn string, ccon string, cext string, cagr string, cneu string", "ISO-8859-1")


def forum_types(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, "mbti_type string, posts string")


def dialogues(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(speaker, dialogue_id, pos, line) of {speaker: {dialogue: {id: [line]}}} documents: files, or else lines."""
    parsed = spark.read.text(path, wholetext=whole).select(F.from_json("value", "map<string,struct<dlg_num:int,dialogue:map<string,array<string>>>>").alias("m"))
    by_speaker = parsed.select(F.explode("m").alias("speaker", "d"))
    by_dialogue = by_speaker.select("speaker", F.explode("d.dialogue").alias("dialogue_id", "lines"))
    return by_dialogue.select("speaker", "dialogue_id", F.posexplode("lines").alias("pos", "line"))


def annotations(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(speaker, dialogue_id, trait, level, utt_ids, nat_lang) of nested annotation documents: files, or else lines."""
    item = "struct<level:string,utt_id:string,nat_lang:string>"
    parsed = spark.read.text(path, wholetext=whole).select(F.from_json("value", f"map<string,struct<annotation:map<string,map<string,{item}>>>>").alias("m"))
    a = parsed.select(F.explode("m").alias("speaker", "v")).select("speaker", F.explode("v.annotation").alias("dialogue_id", "t")).select("speaker", "dialogue_id", F.explode("t").alias("trait", "i"))
    return a.select("speaker", "dialogue_id", "trait", "i.level", X.integers("i.utt_id").alias("utt_ids"), "i.nat_lang")


def kb_source(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """(chunk_id, text, metadata, line) of a JSON Lines source; a missing id is <stem>_<line number in five digits>.

    The line number counts blank lines too; a source file is read as one document.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw")).where(X.strip("raw") != "")
    parsed = lines.withColumn("r", F.from_json("raw", "chunk_id string, text string, metadata map<string,string>")).where("r.text IS NOT NULL")
    return parsed.select(F.coalesce("r.chunk_id", F.format_string(f"{stem}_%05d", F.col("line") + 1)).alias("chunk_id"), "r.text", "r.metadata", (F.col("line") + 1).alias("line"))


def catalogue(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(chunk_id, text, metadata) of all sources: JSON Lines, or markdown and plain files as one chunk each.

    A source that is missing, or of another kind, is left out with a warning.
    """
    out = spark.createDataFrame([], "chunk_id string, text string, metadata map<string,string>")
    for path in paths:
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        stem, _, kind = name.getName().rpartition(".")
        if kind not in ("jsonl", "md", "txt") or not name.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(name):
            warnings.warn(f"source left out: {path}", stacklevel=2)
        elif kind == "jsonl":
            out = out.unionByName(kb_source(spark, path, stem).drop("line"))
        else:
            text = spark.read.text(path, wholetext=True).where(X.strip("value") != "")
            out = out.unionByName(text.select(X.safe_name(F.lit(stem)).alias("chunk_id"), F.col("value").alias("text"), F.expr("cast(map() as map<string,string>)").alias("metadata")))
    return out


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(method, tier, dataset, trait, id, gold_label, predicted_label): every file of a folder; rows without both labels are dropped."""
    rows = json_lines(spark, path, PREDICTION).withColumn("method", _stem())
    full = rows.where("coalesce(gold_label, '') <> '' AND coalesce(predicted_label, '') <> ''")
    return full.select("method", F.regexp_extract("method", r"^(tier[0-9]\w?)_", 1).alias("tier"), F.regexp_extract("method", r"^tier[0-9]\w?_([a-z]+)_", 1).alias("dataset"), F.regexp_extract("method", r"_ocean_([OCEAN])_", 1).alias("trait"), "id", "gold_label", "predicted_label")


def word_vectors(spark: SparkSession, path: str, vocabulary: DataFrame) -> DataFrame:
    """(word, vector) of a text file of word vectors, only for words of `vocabulary` (word)."""
    lines = spark.read.text(path).select(F.split("value", " ").alias("p"))
    rows = lines.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, F.size("p")), lambda x: x.cast("float")).alias("vector"))
    return rows.join(vocabulary.select("word").distinct(), "word", "left_semi")


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
