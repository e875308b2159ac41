"""Finding things: similar vectors, text search, frequent terms, timelines, people, completion, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.operators.fulltext import marked_text, words


def nearest(vectors: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The ``k`` vectors most similar to ``query`` by cosine: (vec_id, similarity).

    One pass over the vectors; each task keeps its best ``k``. Zero vectors and those with components that
    are null, not a number or infinite are similar to nothing. :mod:`talkgrain.operators.vectors` searches
    for many queries at once, by an index.
    """
    given = F.array(*[F.lit(float(x)) for x in query])
    own = F.transform("embedding", lambda x: x.cast("double"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(dot(own, own)) * F.sqrt(dot(given, given))
    scored = vectors.where(F.size("embedding") == len(query)).select(
        "vec_id", F.try_divide(dot(own, given), norm).alias("similarity"))
    return scored.where("similarity is not null and not isnan(similarity)").orderBy(F.desc("similarity"), "vec_id").limit(k)


def tokens(text: Column | str) -> Column:
    """Lower-case words between spaces and line ends."""
    return F.filter(F.split(F.lower(text), "[ \n]+"), lambda w: w != "")


def term_table(documents: DataFrame) -> DataFrame:
    """(doc_id, term, n): the inverted table that searches start from."""
    return documents.select("doc_id", F.explode(words("text")).alias("term")).groupBy(
        "doc_id", "term").agg(F.count("*").alias("n"))


def search(documents: DataFrame, terms: DataFrame, wanted: Sequence[str], *, lang: str | None = None) -> DataFrame:
    """Documents that have all words ``wanted``: (doc_id, hits, marked), matches in brackets.

    Only the terms asked for leave the term table, as one row per document.
    """
    wanted = sorted({w.lower() for w in wanted})
    found = terms.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(
        F.count("*").alias("_n"), F.sum("n").alias("hits")).where(F.col("_n") == len(wanted))
    rows = documents if lang is None else documents.where(F.col("lang") == lang)
    asked = F.array(*[F.lit(w) for w in wanted])
    return rows.join(found, "doc_id").select(
        "doc_id", "hits", marked_text(F.col("text"), asked, F.lit(False)).alias("marked"))


def term_counts(documents: DataFrame, stop_words: DataFrame) -> DataFrame:
    """(term, n) over all documents, without the stop words (term)."""
    return documents.select(F.explode(tokens("text")).alias("term")).groupBy("term").agg(
        F.count("*").alias("n")).join(stop_words, "term", "left_anti")


def frequent_terms(counts: DataFrame, k: int = 50) -> DataFrame:
    return counts.orderBy(F.desc("n"), "term").limit(k)


def timeline(episodes: DataFrame, topics: DataFrame) -> DataFrame:
    """(day, term, n): how often each topic (term) occurs in descriptions, by publishing day."""
    said = episodes.select(
        F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.explode(tokens("description")).alias("term"))
    return said.join(topics.select("term"), "term", "left_semi").groupBy("day", "term").agg(
        F.count("*").alias("n"))


def appearances(utterances: DataFrame, speakers: DataFrame) -> DataFrame:
    """(name, recordings, utterances, first_start, last_end) of each person named in ``speakers``."""
    per = utterances.where("speaker is not null").groupBy("video_id", "speaker").agg(
        F.count("*").alias("n"), F.min("start").alias("from"), F.max("end").alias("to"))
    return per.join(speakers.select("video_id", "speaker", "name"), ["video_id", "speaker"]).groupBy("name").agg(
        F.count_distinct("video_id").alias("recordings"), F.sum("n").alias("utterances"),
        F.min("from").alias("first_start"), F.max("to").alias("last_end"))


def quotes(utterances: DataFrame, speakers: DataFrame, k: int = 3) -> DataFrame:
    """(name, video_id, rank, start, transcript): the ``k`` longest lines of each person in each
    recording."""
    order = Window.partitionBy("video_id", "speaker").orderBy(F.desc(F.length("transcript")), "pos")
    longest = utterances.where("speaker is not null and transcript is not null").select(
        "video_id", "speaker", "pos", "start", "transcript", F.row_number().over(order).alias("rank")).where(
        F.col("rank") <= k)
    return longest.join(speakers.select("video_id", "speaker", "name"), ["video_id", "speaker"]).select(
        "name", "video_id", "rank", "start", "transcript")


def completions(counts: DataFrame, k: int = 5, longest: int = 4) -> DataFrame:
    """(prefix, rank, term, n): the ``k`` most frequent terms for each prefix of up to ``longest``
    characters."""
    sizes = F.sequence(F.lit(1), F.least(F.length("term"), F.lit(longest)))
    each = counts.select("term", "n", F.explode(sizes).alias("size")).select(
        F.expr("left(term, size)").alias("prefix"), "term", "n")
    order = Window.partitionBy("prefix").orderBy(F.desc("n"), "term")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(term: Column) -> Column:
    """A term, and it with each one of its characters left out: terms one edit apart have one in common."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(term), F.lit(1))), lambda i: F.concat(
        F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.length(term))))
    return F.array_distinct(F.concat(F.array(term), every))


def corrections(typed: DataFrame, counts: DataFrame, k: int = 5) -> DataFrame:
    """(typed, rank, term, n, edits): the ``k`` most frequent terms that are what was typed (typed), or one
    character more, less or other; fewer edits first.

    No term is compared with all others: both sides are listed with each character left out and meet in
    equal forms; those that meet are two edits apart at most, and are then measured.
    """
    asked = typed.select("typed").where("typed is not null").distinct().select("typed", F.explode(neighbours(F.col("typed"))).alias("form"))
    known = counts.select("term", "n", F.explode(neighbours(F.col("term"))).alias("form"))
    met = asked.join(known, "form").select("typed", "term", "n").distinct()
    near = met.withColumn("edits", F.levenshtein("typed", "term")).where("edits <= 1")
    order = Window.partitionBy("typed").orderBy("edits", F.desc("n"), "term")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "typed", "rank", "term", "n", "edits")


def usage(events: DataFrame) -> DataFrame:
    """(day, event_type, events, users) of a log of user events."""
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
