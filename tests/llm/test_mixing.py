"""Source mixing: targets, takes, repeats."""

import collections

import pytest
from pyspark.sql import functions as F

from talkgrain.llm import mixing


def make(spark, sizes, nulls=()):
    """Documents of (source, words) rows."""
    rows = [(k, None if k in nulls else " ".join(["w"] * n), "en", s, 0, "x", 5) for k, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, rank string, size int")


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    total = collections.Counter()
    for s, n in sizes:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    free, left = set(names), float(sum(total.values()))
    while free:
        by = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / by >= most * total[s]}
        if not over:
            for s in free:
                target[s] = left * weight[s] / by
            break
        for s in over:
            target[s] = float(most * total[s])
        left -= sum(most * total[s] for s in over)
        free -= over
    return total, target


@pytest.mark.parametrize("block_words", [7, 1024])
@pytest.mark.parametrize("sizes", [
    [("a", 50), ("b", 400), ("c", 30), (None, 900), ("a", 3), ("b", 1), ("d/e", 77), ("é", 5), ("z", 1)],
    [("a", 1), ("b", 10000)], [("only", 12), ("only", 30)], [("a", 0), ("b", 9)],
    [(f"s{k % 40}", 1 + k % 13) for k in range(400)]])
def test_mix(spark, sizes, block_words):
    docs = make(spark, sizes)
    got = mixing.mix_sources(docs, block_words=block_words).collect()
    total, target = fill(sizes)
    assert len(got) == len(sizes)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == sizes[r["doc_id"]][1] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in total:
        assert abs(taken[s] - target[s]) <= 0.5
    again = mixing.mix_sources(docs.repartition(5), block_words=block_words).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_cases(spark):
    docs = make(spark, [("a", 5), ("a", 5), ("b", 7)], nulls={0})
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 1, None).otherwise(F.col("doc_id")))
    docs = docs.unionByName(docs)
    got = mixing.mix_sources(docs).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 5, 5, 7, 7]
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_documents_of_the_mix(spark):
    docs = make(spark, [("a", 50), ("b", 400), ("c", 30)] * 5)
    done = mixing.mixed_documents(docs)
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "rank", "size", "source_size",
                            "target", "taken"]
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect() if r["taken"]}
    assert {r["doc_id"]: r["taken"] for r in done.collect()} == want


def test_points_spread_evenly(spark):
    counted = mixing.slot_counts(mixing.source_targets(
        spark.createDataFrame([("a", 6000), ("b", 3000), ("c", 9000)], "source string, size bigint")), 10)
    n = counted.agg(F.sum("slots")).first()[0]
    rows = mixing.schedule(counted, n).where(F.col("slot") < n // 3).groupBy("rank").count().collect()
    share = {r["rank"]: r["slots"] for r in counted.collect()}
    for r in rows:
        assert abs(r["count"] - share[r["rank"]] / 3) < 8
