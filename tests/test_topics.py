"""Terms of a person, bursts, collocations, corrections."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.operators import search, topics


def test_people_of_few_words_stay_near_the_prior(spark):
    rows = [("A", "budget", 40), ("A", "the", 400), ("B", "garden", 40), ("B", "the", 400), ("C", "budget", 1), ("C", "the", 5)]
    got = topics.distinctive_terms(spark.createDataFrame(rows, "name string, term string, n long")).collect()
    first = {r["name"]: r for r in got if r["rank"] == 1}
    assert first["A"]["term"] == "budget" and first["B"]["term"] == "garden"
    assert all(abs(r["z"]) < 1 for r in got if r["name"] == "C") and first["A"]["z"] > 3


def test_no_utterances_no_topics(spark):
    empty = spark.createDataFrame([], "name string, term string, n long")
    assert topics.distinctive_terms(empty).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_states_are_the_cheapest_of_all(seed):
    rng = np.random.default_rng(seed)
    cases = rng.integers(0, 9, 9)
    n = np.minimum(cases, rng.integers(0, 5, 9))
    if not n.sum():
        n[np.argmax(cases)] = 1
    states, _ = topics.burst_states(n, cases, 2.0, 0.3)
    rate = n.sum() / cases.sum()
    rates = [min(rate, 0.9999), min(0.9999, 2 * rate)]

    def cost(way):
        total = 0.0
        for t, s in enumerate(way):
            p = rates[s]
            total -= n[t] * math.log(p) + (cases[t] - n[t]) * math.log(1 - p)
            total += 0.3 * math.log(len(n)) * (s == 1 and (t == 0 or way[t - 1] == 0))
        return total

    assert cost(states.tolist()) == pytest.approx(min(map(cost, itertools.product((0, 1), repeat=len(n)))))


def test_a_burst_stands_out_and_empty_days_are_filled(spark):
    rows = [(f"2024-01-{d:02d} 10:00:00", "Mars, today" if 20 <= d < 24 or (d == 2 and k == 0) else "other news")
            for d in range(1, 31) if d != 12 for k in range(6)]
    episodes = spark.createDataFrame([*rows, (None, "mars"), ("2024-01-05 00:00:00", None)], "p string, description string").select(
        F.to_timestamp("p").alias("published_at"), "description")
    days = topics.term_days(episodes, spark.createDataFrame([("mars",), ("absent",)], "term string"))
    line = days.first()["days"]
    assert len(line) == 30 and (line[11]["episodes"], line[11]["n"]) == (0, 0) and line[4]["episodes"] == 7
    got = topics.bursts(days).collect()
    assert [(r["term"], r["first_day"], r["last_day"], r["n"]) for r in got] == [("mars", 19, 22, 24)]
    assert topics.term_days(episodes.limit(0), spark.createDataFrame([("mars",)], "term string")).collect() == []


def test_collocations_need_more_than_chance(spark):
    text = "new york is big. " * 20 + "the new the york the is " * 3 + " ".join(f"w{k} is" for k in range(60))
    stops = spark.createDataFrame([("the",), ("is",)], "term string")
    got = topics.collocations(spark.createDataFrame([(text,), (None,), ("one",)], "text string"), stops).collect()
    assert {(r["first"], r["second"]): r["n"] for r in got} == {("new", "york"): 20, ("big", "new"): 19}
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True) and got[-1]["score"] > 0
    assert all("is" not in (r["first"], r["second"]) and r["n"] >= 5 for r in got)


def test_corrections_are_one_edit_away(spark):
    known = spark.createDataFrame([("house", 9), ("mouse", 20), ("houses", 5), ("hose", 50), ("horse", 1), ("hoaxes", 7), ("a", 3), ("é", 2)],
                                  "term string, n long")
    typed = spark.createDataFrame([("house",), ("house",), ("ohuse",), ("b",), ("",), (None,)], "typed string")
    got = {}
    for r in search.corrections(typed, known).orderBy("typed", "rank").collect():
        got.setdefault(r["typed"], []).append((r["term"], r["edits"]))
    assert got == {"house": [("house", 0), ("hose", 1), ("mouse", 1), ("houses", 1), ("horse", 1)], "b": [("a", 1), ("é", 1)],
                   "": [("a", 1), ("é", 1)]}


def test_days_of_terms_take_the_same_plan_however_many(spark):
    def of(days):
        rows = [(f"v{i}", f"2024-01-01 00:00:00", i, "rare word" if i % 9 == 0 else "word") for i in range(0, days, 3)]
        episodes = spark.createDataFrame(rows, "video_id string, at string, i int, description string").withColumn(
            "published_at", F.expr("cast(at as timestamp) + make_interval(0, 0, 0, i)"))
        return topics.term_days(episodes, spark.createDataFrame([("word",), ("rare",), ("absent",)], "term string"))

    long, short = of(1500), of(30)
    # A literal per day in the plan, and a search through all days for each of them, are quadratic work.
    size = len(long._jdf.queryExecution().optimizedPlan().toString())
    assert size < 1.5 * len(short._jdf.queryExecution().optimizedPlan().toString())
    got = {r["term"]: [tuple(x) for x in r["days"]] for r in long.collect()}
    assert set(got) == {"word", "rare"}
    assert got["rare"] == [(t, int(t % 3 == 0), int(t % 9 == 0)) for t in range(1498)]


def test_words_of_a_text_are_found_once_for_pairs(spark, monkeypatch):
    plans = []
    kept = topics.stored
    monkeypatch.setattr(topics, "stored", lambda df, name: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    documents = spark.createDataFrame([("new york is new york",), ("new york new york new york",), (None,), ("one",)], "text string")
    got = topics.collocations(documents, spark.createDataFrame([("is",)], "term string"), least=2).collect()
    assert [(r["first"], r["second"], r["n"]) for r in got] == [("new", "york", 5), ("york", "new", 2)][:len(got)] and got
    assert len(plans) == 1 and plans[0].split("== Initial Plan ==")[0].count("regexp_extract_all") == 1
