"""Toxicity and quality: accuracy on rows kept out of learning, and cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.llm import quality, toxicity
from talkgrain.llm.labelled import fold, parted_texts

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))


@pytest.fixture(scope="module")
def toxic(tables):
    return toxicity.fit(*tables)


def held_out(frame, labels, column):
    told = {r["doc_id"]: r[column] for r in labels.collect()}
    return [(r, told[r["doc_id"]]) for r in frame.collect()
            if r["doc_id"] in told and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]


def test_fold(spark):
    got = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_toxicity_held_out(tables, toxic):
    docs, labels = tables
    pairs = held_out(toxicity.score(docs, toxic), labels, "toxic")
    assert all(r["held_out"] for r, _ in pairs)
    score, y = np.array([r["score"] for r, _ in pairs]), np.array([y for _, y in pairs])
    order = np.empty(len(score))
    order[np.argsort(score)] = np.arange(1, len(score) + 1)
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.93
    predicted = score >= 0.5
    assert (predicted & (y == 1)).sum() / y.sum() > 0.8
    assert (predicted & (y == 0)).sum() / (1 - y).sum() < 0.04
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r, _ in pairs)


def test_toxicity_reads_the_text_alone(documents, toxic):
    rows = [(1, "you stupid idiot clown"), (2, "the and of the"), (3, None), (4, ""), (5, "!! ** \x00"),
            (None, "you stupid idiot clown"), (1, "you stupid idiot clown"), (6, "word " * 40000)]
    got = toxicity.score(documents(rows), toxic).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {str(r["doc_id"]): r["score"] for r in got}
    assert by["1"] == pytest.approx(by["None"]) and by["1"] > by["2"] and by["3"] == pytest.approx(by["4"])
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert toxicity.score(documents([]), toxic).count() == 0


def test_toxicity_learns():
    texts = ["bad words here", "good words there", "so bad", "so good indeed"] * 10
    model = toxicity.train(texts, np.array([1, 0, 1, 0] * 10), np.ones(40))
    score = model.scores(toxicity._texts(texts[:4]))
    assert score[[0, 2]].min() > 0.5 > score[[1, 3]].max()


def _told(spark, texts):
    """Documents and labels of (text, toxic)."""
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    return docs, spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(texts)], "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_from_all_parts(spark):
    """Each foul word is in few documents, which are spread over the parts; one in ten documents comes twice."""
    rng = np.random.default_rng(1)
    plain = ["w" + "".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(200)]
    foul = ["x" + "".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(40)]
    texts = [(" ".join([*rng.choice(plain, 12), *([foul[k % 40]] if k % 2 else [])]), k % 2) for k in range(1600)]
    docs, labels = _told(spark, texts)
    docs = docs.unionByName(docs.where("doc_id % 10 = 0"))
    rows, totals = parted_texts(docs, labels, "toxic", 300, 32)
    ids = {r["doc_id"] for r in rows.collect()}
    assert ids == {k for k in range(1600) if zlib.crc32(str(k).encode()) % 5} and sum(totals.values()) == len(ids)
    homes = rows.select("part", F.spark_partition_id().alias("home")).distinct().collect()
    assert len(homes) == len({r["part"] for r in homes}) == 5
    model = toxicity.fit(docs, labels, 300)
    again = toxicity.fit(docs.repartition(7), labels, 300)
    assert model.embedding.tobytes() == again.embedding.tobytes() and list(model.thresholds) == list(again.thresholds)
    pairs = held_out(toxicity.score(docs, model), labels, "toxic")
    hit = [r["predicted"] == y for r, y in pairs]
    assert len(hit) > 250 and np.mean(hit) > 0.95


def test_toxicity_learns_from_long_texts(spark):
    """All toxic texts are longer than 20,000 bytes, which were left out."""
    texts = [("some words of good cheer " * 30, 0) for _ in range(60)] + [
        ("some words of good cheer " * 900 + "vile insult " * 3, 1) for _ in range(40)]
    docs, labels = _told(spark, texts)
    pairs = held_out(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic")
    assert {y for _, y in pairs} == {0, 1} and all(r["predicted"] == y for r, y in pairs)


def test_toxicity_batches_have_every_row():
    y = np.array([1] * 7 + [0] * 300)
    steps = list(toxicity._balanced(np.random.default_rng(0), y, 1))
    assert set(np.concatenate(steps)) == set(range(307))
    assert all(y[rows].sum() * 2 == len(rows) for rows in steps)
    assert set(np.concatenate(list(toxicity._balanced(np.random.default_rng(0), y[:7], 1)))) == set(range(7))
    assert not list(toxicity._balanced(np.random.default_rng(0), y[:0], 1))


def test_toxicity_steps_on_long_texts_in_pieces(monkeypatch):
    texts = [f"word{k} other words{k % 3} " * (3 + k % 5) for k in range(24)]
    got = []
    for most in (1 << 20, 100):
        monkeypatch.setattr(toxicity, "STEP_BYTES", most)
        adam = toxicity._Adam(toxicity._unlearned(3), np.random.default_rng(5))
        for _ in range(3):
            adam.learn(texts, np.arange(24, dtype=np.float32) % 2, 0.01)
        got.append(toxicity._packed(adam.model))
    assert got[0] == pytest.approx(got[1], abs=1e-3)


def test_toxicity_of_one_class_in_many_parts(spark):
    docs, labels = _told(spark, [(f"text {k}", 1) for k in range(60)])
    got = toxicity.score(docs, toxicity.fit(docs, labels, 10)).collect()
    assert {r["predicted"] for r in got} == {1}
    docs, labels = _told(spark, [(f"text {k} nasty" if k % 30 == 1 else f"text {k}", int(k % 30 == 1)) for k in range(200)])
    assert toxicity.score(docs, toxicity.fit(docs, labels, 5)).count() == 200


def test_toxicity_ignores_neighbours(toxic):
    texts = ["you stupid idiot", "", "the and of", "clown", "", "idiot"]
    together = toxic.scores(toxicity._texts(texts))
    assert together == pytest.approx([toxic.scores(toxicity._texts([t]))[0] for t in texts])


@pytest.mark.parametrize("learn", [toxicity.train, quality.train])
def test_without_both_classes(learn):
    for y in ([], [0, 0], [1, 1]):
        learn(["some text"] * len(y), np.array(y, np.int64), np.ones(len(y)))


def test_quality_held_out(tables):
    docs, labels = tables
    got = quality.judged(docs, labels)
    pairs = held_out(got, labels, "quality")
    good = [r["keep"] for r, y in pairs if y == 1]
    poor = [r["keep"] for r, y in pairs if y == 0]
    assert np.mean(good) > 0.99 and np.mean(poor) < 0.03
    assert got.count() == docs.count()


def test_sites_shrink_toward_the_prior(spark):
    """Posteriors against a restatement; a small site stays nearer its prior than a large one."""
    rng = np.random.default_rng(0)
    junk, fine = "$$$ *** ### !!! &&& " * 8, "some plain prose that reads well enough here. " * 4
    rows = []
    for k in range(400):
        site = "big.org/a" if k < 150 else "small.org/b" if k < 154 else f"s{k % 11}.org/c"
        bad = rng.random() < (0.9 if k < 154 else 0.2)
        rows.append((k, junk if bad else fine, "en", site, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, host int")
    labels = spark.createDataFrame([(k, int(r[1] == fine), 0) for k, r in enumerate(rows)],
                                   "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.posteriors(docs, model).collect()}
    p = {k: round(1e6 / (1 + np.exp(-r["evidence"]))) / 1e6 for k, r in got.items()}
    mean = np.mean(list(p.values()))
    host = lambda k: rows[k][3].split("/")[0]
    hosts = {}
    for k in p:
        hosts.setdefault(host(k), []).append(p[k])
    n = np.array([len(v) for v in hosts.values()])
    spread = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values())
    within = mean * (1 - mean)
    between = (spread - (len(n) - 1) * within) / (n.sum() - (n ** 2).sum() / n.sum())
    strength = min(max(within / max(between, 1e-9) - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)
    for k, r in got.items():
        own = hosts[host(k)]
        want = (sum(own) - p[k] + strength * mean) / (len(own) - 1 + strength)
        assert r["host_posterior"] == pytest.approx(want, abs=1e-4)
    assert got[0]["host_posterior"] < got[151]["host_posterior"] < mean


def test_quality_cases(spark, documents, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    rows = [(1, None), (2, ""), (None, "some text"), (3, "\x00\x01"), (3, "la " * 50000), (4, "ok " * 3)]
    plain = documents(rows)
    got = quality.posteriors(plain, model).collect()
    assert len(got) == len(rows) and all(0 < r["quality"] < 1 for r in got)
    nulls = plain.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    assert quality.posteriors(nulls, model).count() == len(rows)
    assert quality.posteriors(documents([]), model).count() == 0
    kept = quality.good_documents(plain, labels)
    assert kept.columns == plain.columns
    assert [r["doc_id"] for r in kept.collect()].count(None) == 1
    none = labels.limit(0)
    assert {r["evidence"] for r in quality.judged(plain, none).collect()} == {0.0}
