"""What is talked about: terms of a person, bursts of a term over days, word pairs that belong together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.operators.fulltext import words
from talkgrain.plans.scratch import stored
from talkgrain.plans.ship import ship_package

#: Words of the prior: a person with fewer of their own stays near what all say.
PRIOR = 500.0
#: How many times its usual rate a term has in a burst, and what entering one costs.
RAISED, ENTRY = 2.0, 1.0


def person_terms(utterances: DataFrame, speakers: DataFrame) -> DataFrame:
    """(name, term, n): how often each person named in ``speakers`` says each word."""
    said = utterances.where("speaker is not null").select("video_id", "speaker", F.explode(words("transcript")).alias("term"))
    # Counted per recording first: the join moves one row per word and speaker of a recording.
    said = said.groupBy("video_id", "speaker", "term").agg(F.count("*").alias("n"))
    return said.join(speakers.select("video_id", "speaker", "name"), ["video_id", "speaker"]).groupBy("name", "term").agg(
        F.sum("n").alias("n"))


def distinctive_terms(counts: DataFrame, k: int = 10, prior: float = PRIOR) -> DataFrame:
    """(name, rank, term, n, z): the ``k`` terms that most set each person apart from all others.

    ``counts`` is (name, term, n). z is the log odds of the term with the person against the others, over its
    standard error; both sides are first given ``prior`` words spread like those of all persons together, so
    rare terms and people of few words score near 0. Terms that the person uses less than others are left out.
    """
    terms = counts.groupBy("term").agg(F.sum("n").alias("all_n"))
    people = counts.groupBy("name").agg(F.sum("n").alias("own"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.join(terms, "term").join(people, "name")
    a = F.lit(prior) * F.col("all_n") / F.lit(float(max(total, 1)))
    here, there = F.col("n") + a, F.col("all_n") - F.col("n") + a
    odds = F.log(here / (F.col("own") + F.lit(prior) - here)) - F.log(
        there / (F.lit(float(total)) - F.col("own") + F.lit(prior) - there))
    scored = rows.withColumn("z", F.round(odds / F.sqrt(1 / here + 1 / there), 6)).where("z > 0")
    order = Window.partitionBy("name").orderBy(F.desc("z"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "name", "rank", "term", "n", "z")


# -- bursts -------------------------------------------------------------------

def term_days(episodes: DataFrame, topics: DataFrame) -> DataFrame:
    """(term, days): for each topic, in order, every day from the first to the last with an episode: its
    number, the episodes published and those whose description has the term. Days without any are 0."""
    dated = episodes.where("published_at is not null").withColumn("day", F.to_date("published_at"))
    per_day = dated.groupBy("day").agg(F.count("*").cast("int").alias("episodes"))
    said = dated.select("day", F.explode(F.array(F.array_distinct(words("description")))).alias("terms"))
    having = said.select("day", F.explode("terms").alias("term")).join(topics.select("term"), "term", "left_semi").groupBy(
        "term", "day").agg(F.count("*").cast("int").alias("n"))
    # At most one row per topic and day, found by reading all descriptions twice: kept for both its uses.
    having = stored(having, "term-days")
    ends = per_day.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    if ends["first"] is None:
        return having.select("term", F.array().cast("array<struct<day:int,episodes:int,n:int>>").alias("days")).limit(0)
    day = F.datediff("day", F.lit(ends["first"]))
    length = (ends["last"] - ends["first"]).days
    # Every term meets every day as rows, so that the work grows with their number and not with its square.
    every = having.select("term").distinct().select("term", F.explode(F.sequence(F.lit(0), F.lit(length))).alias("day"))
    rows = every.join(per_day.select(day.alias("day"), "episodes"), "day", "left").join(
        having.select("term", day.alias("day"), "n"), ["term", "day"], "left").select("term", F.struct(
            "day", F.coalesce("episodes", F.lit(0)).alias("episodes"), F.coalesce("n", F.lit(0)).alias("n")).alias("at"))
    return rows.groupBy("term").agg(F.sort_array(F.collect_list("at")).alias("days"))


def burst_states(n: np.ndarray, episodes: np.ndarray, raised: float = RAISED, entry: float = ENTRY) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest way through the two states, usual and burst, and by how much a day is cheaper in a burst."""
    total, cases = int(n.sum()), int(episodes.sum())
    rates = [total / cases, min(0.9999, raised * total / cases)]
    rates[0] = min(rates[0], 0.9999)
    cost = np.array([-(n * np.log(p) + (episodes - n) * np.log(1 - p)) for p in rates])
    step = entry * np.log(len(n))
    came = np.zeros((2, len(n)), np.int8)
    low, high = 0.0, step
    for t in range(len(n)):
        came[0, t], came[1, t] = low > high, high <= low + step
        low, high = cost[0, t] + min(low, high), cost[1, t] + min(low + step, high)
    states = np.zeros(len(n), np.int8)
    at = int(low > high)
    for t in range(len(n) - 1, -1, -1):
        states[t], at = at, came[at, t]
    return states, cost[0] - cost[1]


def bursts(days: DataFrame, raised: float = RAISED, entry: float = ENTRY) -> DataFrame:
    """(term, first_day, last_day, n, strength): the runs of days in which a term is in its burst state.

    A term occurs in a day's episodes at its overall rate, or in a burst at ``raised`` times that; entering a
    burst costs ``entry`` times the log of the number of days. The states of all days are those of least cost,
    found day by day; strength is what the run saves against the usual rate. Days count from 0, that of the
    first episode."""
    ship_package(days.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for term, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, cases = (line.values.field(c).to_numpy().astype(np.int64) for c in ("n", "episodes"))
                if not n.sum():
                    continue
                states, gain = burst_states(n, cases, raised, entry)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], states, [0]])))
                out += [(term, int(a), int(b) - 1, int(n[a:b].sum()), float(np.round(gain[a:b].sum(), 6)))
                        for a, b in edges.reshape(-1, 2)]
            columns = zip(*out, strict=True) if out else ((),) * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["term", "first_day", "last_day", "n", "strength"])

    return days.mapInArrow(run, "term string, first_day int, last_day int, n bigint, strength double")


# -- collocations --------------------------------------------------------------

def _part(observed: Column, row: Column, column: Column, total: Column) -> Column:
    return F.when(observed > 0, observed * F.log(observed * total / (row * column))).otherwise(F.lit(0.0))


def collocations(documents: DataFrame, stop_words: DataFrame, k: int = 50, least: int = 5) -> DataFrame:
    """(first, second, n, score): the ``k`` pairs of neighbouring words that most go together, by Dunning's log
    likelihood ratio, among those that occur ``least`` times and more often than chance. Pairs with a
    stop word (term) are not subjects, but their words count."""
    # Listed before they are filtered or taken apart: what stands above a list's expression would repeat it.
    own = documents.select(F.explode(F.array(words("text"))).alias("w")).where("size(w) > 1")
    pairs = own.select(F.explode(F.zip_with(
        F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1),
        lambda a, b: F.struct(a.alias("first"), b.alias("second")))).alias("p"))
    counts = stored(pairs.groupBy("p.first", "p.second").agg(F.count("*").alias("n")), "pair-counts")
    left = counts.groupBy("first").agg(F.sum("n").alias("n_first"))
    right = counts.groupBy("second").agg(F.sum("n").alias("n_second"))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    total = F.lit(float(whole))
    stops = stop_words.select("term")
    kept = counts.where(F.col("n") >= least).join(stops, F.col("first") == F.col("term"), "left_anti").join(
        stops, F.col("second") == F.col("term"), "left_anti")
    rows = kept.join(left, "first").join(right, "second").where(F.col("n") * total > F.col("n_first") * F.col("n_second"))
    a, b = F.col("n"), F.col("n_first") - F.col("n")
    c, d = F.col("n_second") - F.col("n"), total - F.col("n_first") - F.col("n_second") + F.col("n")
    ratio = (_part(a, F.col("n_first"), F.col("n_second"), total) + _part(b, F.col("n_first"), total - F.col("n_second"), total)
             + _part(c, total - F.col("n_first"), F.col("n_second"), total)
             + _part(d, total - F.col("n_first"), total - F.col("n_second"), total))
    return rows.select("first", "second", "n", F.round(2 * ratio, 4).alias("score")).orderBy(
        F.desc("score"), "first", "second").limit(k)
