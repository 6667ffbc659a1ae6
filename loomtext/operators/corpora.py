"""Raw corpora to unified records.

A record has id, text, label_mbti, source and counts. Null and blank texts give no record; repeated rows give
repeated records unless a key is named; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import text as X
from loomtext.session import written


def forum_records(rows: DataFrame, min_words: int = 10, id_col: str = "row_id", normalize: bool = True) -> DataFrame:
    """One record for each user with a valid type and a post of at least min_words; all within the row, no shuffle."""
    normal = X.nfkc(F.col("posts")) if normalize else F.col("posts")  # the whole row's text at once: posts are an array
    posts = F.split(F.regexp_replace("_normal", "^'|'$", ""), r"\|\|\|")
    kept = F.filter(F.transform(posts, lambda p: X.clean(p, normalize=False)), lambda p: X.word_count(p) >= min_words)
    own = rows.withColumns({"label_mbti": L.mbti("mbti_type"), "_normal": normal}).where("label_mbti IS NOT NULL")
    out = own.select(id_col, "posts", "label_mbti", kept.alias("kept")).where("size(kept) > 0")
    total = F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, p: a + X.word_count(p))
    return out.select(
        id_col, L.record_id("mbti", "posts").alias("id"), F.array_join("kept", " ").alias("text"), "label_mbti", F.size("kept").cast("bigint").alias("n_posts"), F.round(total / F.size("kept"), 6).alias("mean_words")
    )


def latest_comments(comments: DataFrame) -> DataFrame:
    """One row for each comment_id: the one ingested last; of equal times the greatest body."""
    newest = F.max_by(F.struct("author", "body", "lang", "subreddit", "created_at", "ingested_at"), F.struct("ingested_at", F.coalesce("body", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("author", F.lit(""))))
    return comments.where("comment_id IS NOT NULL").groupBy("comment_id").agg(newest.alias("r")).select("comment_id", "r.*")


def eligible_authors(profiles: DataFrame) -> DataFrame:
    """(author, label_mbti, complete): authors with a valid type or all five scores; one row for each name."""
    named = profiles.withColumn("author", X.strip("author")).where("author <> ''")
    complete = F.lit(True)
    for c in L.TRAIT_NAMES.values():
        complete = complete & F.col(c).isNotNull()
    each = named.select("author", L.mbti("mbti").alias("label_mbti"), complete.alias("complete"))
    return each.groupBy("author").agg(F.max("label_mbti").alias("label_mbti"), F.max("complete").alias("complete")).where("label_mbti IS NOT NULL OR complete")


def usable_comments(comments: DataFrame, authors: DataFrame, min_words: int = 5, normalize: bool = True) -> DataFrame:
    """(comment_id, author, cleaned) of English comments of eligible authors that no bot wrote; cheap tests come first.

    Cleaned texts are written before their words are counted: as one plan the cleaning would stand in it twice.
    """
    plain = comments.where("body IS NOT NULL AND lang = 'en'").withColumn("author", X.strip("author"))
    plain = plain.where((X.strip("body") != "") & ~X.is_bot("body")).join(authors.select("author"), "author", "left_semi")
    cleaned = written(plain.select("comment_id", "author", X.clean(X.forum_clean("body"), normalize=normalize).alias("cleaned")), "cleaned")
    return cleaned.where(X.word_count("cleaned") >= min_words)


def author_records(comments: DataFrame, profiles: DataFrame, per_author: int = 100, normalize: bool = True) -> DataFrame:
    """One record for each eligible author: at most per_author comments, those whose ids' MD5 comes first.

    The limit is applied before the shuffle too, so an author with a large share of all rows is no hot spot.
    """
    authors = eligible_authors(profiles)
    usable = usable_comments(comments, authors, normalize=normalize)
    totals = usable.groupBy("author").agg(F.count("*").alias("n_total"))
    order = Window.partitionBy("author").orderBy(F.md5(F.col("comment_id").cast("string")), "comment_id")
    chosen = usable.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_author)
    joined = chosen.groupBy("author").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cleaned"))), lambda x: x["cleaned"]), " ").alias("text"), F.count("*").alias("n_sampled"))
    return joined.join(totals, "author").join(authors, "author").select(L.record_id("pandora", "author").alias("id"), "author", "text", "label_mbti", "n_sampled", "n_total")


def parsed_turns(turns: DataFrame) -> DataFrame:
    """(dialogue_id, speaker, utt_id, said), distinct; a null speaker is UNKNOWN and turn headers are taken off."""
    body = X.strip("utterance")
    said = F.regexp_replace(F.regexp_replace(body, r"^Utterance\s+\d+\s+.+?\s+said:\s*", ""), "^第[0-9]+句.+?说[：:]", "")
    return turns.where("utterance IS NOT NULL AND dialogue_id IS NOT NULL").select("dialogue_id", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), "utt_id", X.strip(said).alias("said")).distinct()


def speaker_records(turns: DataFrame) -> DataFrame:
    """(id, dialogue_id, speaker, text, n_utterances): a speaker's utterances in the order of turns."""
    listed = parsed_turns(turns).groupBy("dialogue_id", "speaker").agg(F.sort_array(F.collect_list(F.struct("utt_id", "said"))).alias("all"))
    return listed.select(
        L.record_id("personality_evd", F.concat_ws("|", "dialogue_id", "speaker")).alias("id"), "dialogue_id", "speaker", F.array_join(F.transform("all", lambda x: x["said"]), " ").alias("text"), F.size("all").cast("bigint").alias("n_utterances")
    )


def evidence_quotes(evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """(dialogue_id, speaker, trait, level, quote): the named turns of the speaker, of anyone where that gives none.

    Evidence of a dialogue that doesn't exist, or whose turns don't, keeps a null quote.
    """
    said = parsed_turns(turns)
    each = evidence.select("dialogue_id", "speaker", "trait", L.level("level_raw").alias("level"), "utt_ids").withColumn("key", F.xxhash64("dialogue_id", "speaker", "trait", "level", "utt_ids"))
    wanted = each.select("key", "dialogue_id", F.col("speaker").alias("target"), F.explode("utt_ids").alias("utt_id")).distinct()
    found = wanted.join(said, ["dialogue_id", "utt_id"])
    joined = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("utt_id", "said")))), lambda x: x["said"]), " ")
    quotes = found.groupBy("key").agg(F.nullif(joined(F.col("speaker") == F.col("target")), F.lit("")).alias("own"), joined(F.lit(True)).alias("any"))
    return each.join(quotes, "key", "left").select("dialogue_id", "speaker", "trait", "level", F.coalesce("own", "any").alias("quote"))


def annotated_dialogues(annotations: DataFrame, dialogues: DataFrame) -> DataFrame:
    """annotations with `turns`, their speaker's lines in their dialogue: none where there is no such dialogue.

    Annotations of a speaker who has no dialogue at all are left out.
    """
    listed = dialogues.groupBy("speaker", "dialogue_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("turns"))
    known = annotations.join(dialogues.select("speaker").distinct(), "speaker", "left_semi")
    return known.join(listed, ["speaker", "dialogue_id"], "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<string>")))


def quotes_in_text(quotes: DataFrame, records: DataFrame) -> DataFrame:
    """(trait, items, n_quotes, in_text): evidence, quotes that aren't empty, and those that stand in their speaker's record."""
    own = quotes.join(records.select("dialogue_id", "speaker", "text"), ["dialogue_id", "speaker"], "left")
    some = F.col("quote") != ""
    return own.groupBy("trait").agg(F.count("*").alias("items"), F.count_if(some).alias("n_quotes"), F.count_if(some & F.contains("text", "quote")).alias("in_text"))
