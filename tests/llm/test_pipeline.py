"""Registered queries against SQL, and the pipeline stage by stage against brute force."""

import brute
import duckdb
import pytest

import corpus_pipeline
from talkgrain.llm.queries import LLM_ORACLE, LLM_QUERIES
from talkgrain.plans.scratch import stored

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = LLM_QUERIES[name](spark, SMALL)
    cursor = duck.execute(LLM_ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_one_query_per_operator():
    assert {n.split("_")[0] for n in LLM_QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        columns = docs.columns
        docs = stored(stage(spark, docs, SMALL), name)
        rows[name] = {r["doc_id"]: r for r in docs.collect()}
        assert len(rows[name]) == docs.count()
        if name != "mixing":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert set(rows[name]) == {c for _, _, c in brute.jaccard(list(before.items()))}
        elif name == "suffix_dedup":
            for i, n, gone, *_ in brute.bytes_dedup(list(before.items()), 200):
                left = len(rows[name][i]["text"].encode())
                assert n - gone - 6 * (gone > 0) <= left <= n - gone
        else:
            assert set(rows[name]) <= set(before)
            assert all(r["text"] == before[i] for i, r in rows[name].items())
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(i in rows["quality"] for i, q in quality.items() if q)
    assert not any(i in rows["quality"] for i, q in quality.items() if not q)
    assert all(0 < r["taken"] <= 3 * r["size"] for r in rows["mixing"].values())


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, docs.collect()))


def test_rows_without_id_and_texts_of_one_id_are_judged_by_themselves(spark, documents, prose):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    a, b = prose(80), prose(90)
    rows = [(1, a), (1, b), (None, a + " tail"), (None, prose(70)), (None, item), (2, item), (2, prose(60)), (3, b), (4, b), (4, b)]
    docs = documents(rows, extra=False)

    def texts(df):
        assert df.columns == docs.columns
        return sorted(map(str, ((r["doc_id"], r["text"]) for r in df.collect())))

    kept = texts(corpus_pipeline.distinct(spark, docs, SMALL))
    assert len(kept) == 5  # of a and its tail one, of the copies of b one, the item once, two texts of their own
    assert sum("tail" in k or a in k for k in kept) == 1 and sum(b in k for k in kept) == 1 and sum(item in k for k in kept) == 1
    clean = texts(corpus_pipeline.untested(spark, docs, SMALL))
    assert clean == sorted(str(r) for r in rows if item not in r[1])


def test_a_poor_text_does_not_take_a_good_one_of_its_id_along(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good, poor = ({r["doc_id"]: r["text"] for r in docs.join(labels.where(f"quality = {q}"), "doc_id").collect()} for q in (1, 0))
    (first, text), bad = min(good.items()), min(poor.items())[1]
    odd = spark.createDataFrame([(first, bad), (None, bad), (None, text + " more")], "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'src0' as source", "cast(length(text) as bigint) as n_chars")
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.good(spark, docs.unionByName(odd.select(docs.columns)), SMALL).collect()}
    assert (first, text) in kept and (None, text + " more") in kept
    assert (first, bad) not in kept and (None, bad) not in kept


def test_empty(spark, documents):
    docs = documents([(1, None)], extra=False).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.count() == 0
