"""Vector search and full-text search over stored indexes."""

import math
import random
import re

import numpy as np
import pytest

from talkgrain.operators import fulltext, search, vectors

SCHEMA = "vec_id bigint, embedding array<double>"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], schema)


def best(rows, query, k):
    q = np.array(query) / np.abs(query).max()
    near = []
    for i, v in rows:
        x = np.array(v) / np.abs(v).max()
        near.append((-(q @ x) / math.sqrt(q @ q) / math.sqrt(x @ x), i))
    return [i for _, i in sorted(near)[:k]]


def test_nearest_passes_over_vectors_without_direction(spark):
    rows = [(1, [1, 0]), (2, [1, 0.1]), (3, [0, 0]), (4, [math.nan, 1]), (5, [math.inf, 1]), (6, [None, 1]), (7, None), (8, [1, 2, 3])]
    got = search.nearest(table(spark, rows), [1.0, 0.0], 5).collect()
    assert [r["vec_id"] for r in got] == [1, 2]


def drawn(n, dim, decay, seed, groups=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * decay ** np.arange(dim)
    if groups:
        x = x[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, dim)) * decay ** np.arange(dim)
    return list(enumerate(x.tolist()))


@pytest.mark.parametrize("dim,decay,groups", [(16, 1.0, 0), (48, 0.8, 0), (32, 1.0, 20)])
def test_exact_search_equals_brute_force(spark, tmp_path, dim, decay, groups):
    rows = drawn(1500, dim, decay, dim, groups)
    path = str(tmp_path / "index")
    vectors.write_index(table(spark, rows[:1000]), path, bits=5)
    vectors.add_vectors(table(spark, rows[1000:]), path)
    asked = rows[::100]
    queries = table(spark, asked, "query_id bigint, embedding array<double>")
    got = {}
    for r in sorted(vectors.search(spark, path, queries, 7, probes=2, exact=True).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {i: best(rows, v, 7) for i, v in asked}


def test_probed_search_of_the_given_vectors(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = str(tmp_path / "index")
    vectors.write_index(given, path, bits=6)
    queries = given.where("vec_id % 40 = 0").selectExpr("vec_id as query_id", "embedding")
    assert queries.count() == 50
    probes = vectors.probes_for(spark, path, queries, 10, recall=0.9)
    exact = {(r["query_id"], r["vec_id"]) for r in vectors.search(spark, path, queries, 10, exact=True).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in vectors.search(spark, path, queries, 10, probes=probes).collect()}
    rows = [(r["vec_id"], r["embedding"]) for r in given.collect()]
    truth = {(q, v) for q, e in rows if q % 40 == 0 for v in best(rows, e, 10)}
    assert exact == truth
    assert len(found & truth) >= 0.9 * len(truth)


def test_grouped_vectors_need_few_probes_and_read_few_directories(spark, tmp_path, capfd):
    rows = drawn(4000, 32, 1.0, 3, 40)
    path = str(tmp_path / "index")
    vectors.write_index(table(spark, rows), path, bits=8)
    queries = table(spark, rows[::80], "query_id bigint, embedding array<double>")
    truth = {(i, v) for i, e in rows[::80] for v in best(rows, e, 10)}
    found = {(r["query_id"], r["vec_id"]) for r in vectors.search(spark, path, queries, 10, probes=16).collect()}
    assert len(found & truth) >= 0.9 * len(truth)
    one = table(spark, rows[:1], "query_id bigint, embedding array<double>")
    vectors.search(spark, path, one, 10, probes=3).explain("formatted")
    plan = capfd.readouterr().out
    filters = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    assert any(re.search(r"bucket#\d+ IN \((\d+,? ?){3}\)", f) for f in filters)


def test_odd_vectors_are_neither_stored_nor_searched_for(spark, tmp_path):
    rows = [(1, [1, 0, 0]), (2, [1e-30, 1e-31, 0]), (3, [1e200, 0, 1e199]), (4, [0, 0, 0]), (5, [math.nan, 1, 1]), (6, None), (7, []),
            (8, [None, 1, 1]), (9, [math.inf, 0, 0]), (10, [1, 2]), (11, [2, 4]), (12, [1, 0, 0]), (13, [-1, 0, 0])]
    path = str(tmp_path / "index")
    vectors.write_index(table(spark, rows), path, bits=2)
    queries = table(spark, [(1, [5e-300, 0, 0]), (2, [1, 2]), (3, [math.nan, 1, 1]), (4, [1, 2, 3, 4]), (5, None)],
                    "query_id bigint, embedding array<double>")
    got = vectors.search(spark, path, queries, 3, probes=1, exact=True).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(1, 1), (1, 12), (1, 2), (2, 10), (2, 11)]
    assert got[0]["similarity"] == pytest.approx(1)


# -- text ---------------------------------------------------------------------

def index(spark, tmp_path, rows, **layout):
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    path = str(tmp_path / "text")
    fulltext.write_index(documents, path, columns=("kind",), **layout)
    return documents, path


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def expected(rows, asked, phrase, k, kinds=None):
    own = {i: words(t) for i, t, _ in rows}
    average = sum(map(len, own.values())) / len(own)
    out = []
    for i, _, kind in rows:
        starts = [p for p in range(len(own[i])) if own[i][p:p + len(asked)] == asked]
        if (kinds and kind not in kinds) or not set(asked) <= set(own[i]) or (phrase and not starts):
            continue
        score = 0
        for w in set(asked):
            n, df = own[i].count(w), sum(w in v for v in own.values())
            score += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own[i]) / average))
        out.append((-round(score, 6), i, len(starts) if phrase else sum(own[i].count(w) for w in set(asked))))
    return [(i, pytest.approx(-s, abs=2e-6), n) for s, i, n in sorted(out)[:k]]


def test_ranked_search_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["to", "be", "or", "not", "Über", "x1", "the", "The"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), rng.choice("ab"))
            for i in range(60)]
    rows += [(100, "to be or not to be " * 30, "a"), (101, None, "a"), (102, "", "b"), (103, "--", "b")]
    documents, path = index(spark, tmp_path, rows, block=8, halo=5)
    asked = [(1, "to be or not to be", True), (2, "be to", False), (3, "the the", True), (4, "über X1", False), (5, "absent", False),
             (6, "", True), (7, "TO, to!", False)]
    queries = spark.createDataFrame(asked, "query_id int, text string, phrase boolean")
    for kinds in (None, ["a"]):
        where = None if kinds is None else "kind = 'a'"
        got = {}
        for r in fulltext.search(spark, path, queries, 9, where=where).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"], r["hits"]))
        for q, text, phrase in asked:
            assert got.get(q, []) == (expected(rows, words(text), phrase, 9, kinds) if words(text) else []), q


def test_phrases_longer_than_the_halo_are_refused(spark, tmp_path):
    _, path = index(spark, tmp_path, [(1, "a b c d", "x")], halo=2)
    asked = spark.createDataFrame([(1, "a b c d", True)], "query_id int, text string, phrase boolean")
    with pytest.raises(ValueError):
        fulltext.search(spark, path, asked)


def test_marks_stand_where_the_words_are(spark, tmp_path):
    rows = [(1, "with\nWith, (with) from, a from", "x"), (2, "from\nwith us from with", "x")]
    documents, path = index(spark, tmp_path, rows)
    queries = spark.createDataFrame([(1, "from with", False), (2, "from with", True), (3, "with with", True)],
                                    "query_id int, text string, phrase boolean")
    got = fulltext.marked(fulltext.search(spark, path, queries), queries, documents).collect()
    assert {(r["query_id"], r["doc_id"]): r["marked"] for r in got} == {
        (1, 1): "[with]\n[With], ([with]) [from], a [from]", (1, 2): "[from]\n[with] us [from] [with]",
        (2, 2): "[from]\n[with] us [from] [with]", (3, 1): "[with]\n[With], ([with]) from, a from"}


def test_a_search_reads_the_directories_of_its_words(spark, tmp_path, capfd):
    _, path = index(spark, tmp_path, [(i, f"common word{i}", "x") for i in range(200)])
    asked = spark.createDataFrame([(1, "word7", False)], "query_id int, text string, phrase boolean")
    found = fulltext.search(spark, path, asked)
    found.explain("formatted")
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d+\)?\]", capfd.readouterr().out)
    assert [r["doc_id"] for r in found.collect()] == [7]
