"""Jaccard join, byte and word deduplication against brute force."""

import brute
import pytest
from brute import mutated
from pyspark.sql import functions as F

from talkgrain.llm import jaccard, repeats, substrings, suffixes, text


SMALL = "/root/testdata/sf0.001"


def fixture(prose):
    base, passage = prose(120), prose(70)
    rows = [(k, mutated(prose, base, k % 9)) for k in range(60)]
    rows += [(100 + k, prose(40)) for k in range(20)]
    rows += [(130 + k, prose(30) + " " + passage + " " + prose(25 + k)) for k in range(12)]
    rows += [(150, rows[3][1]), (151, rows[3][1].upper()), (152, None), (153, ""), (154, " \t\n "),
             (155, "one two"), (156, "One  TWO"), (157, "word"), (158, "la " * 400), (159, "la " * 390),
             (160, "ünïcødé " * 60), (161, prose(3000)), (162, rows[70][1] + " " + rows[70][1])]
    return rows + [(7, rows[7][1])]  # a repeated row


def test_jaccard_join(documents, prose, monkeypatch):
    rows = fixture(prose)
    monkeypatch.setattr(jaccard, "TILE", 500)
    monkeypatch.setattr(jaccard, "SENT", 5)
    got = jaccard.link_components(documents(rows))
    assert sorted(map(tuple, got.collect())) == brute.jaccard(rows)


def test_jaccard_shuffled_candidates(documents, prose, monkeypatch):
    rows = fixture(prose)
    monkeypatch.setattr("talkgrain.llm.components.BROADCAST_ROWS", 3)
    monkeypatch.setattr(text, "SLICE_BYTES", 300)
    got = jaccard.link_components(documents(rows, parts=6))
    assert sorted(map(tuple, got.collect())) == brute.jaccard(rows)


def test_jaccard_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.link_components(docs).collect())) == brute.jaccard(rows)


def test_jaccard_null_ids_and_empty(documents):
    got = jaccard.link_components(documents([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]))
    assert sorted(map(str, got.collect())) == sorted([
        "Row(doc_id=None, n_shingles=2, component_id=None)", "Row(doc_id=1, n_shingles=2, component_id=1)",
        "Row(doc_id=2, n_shingles=2, component_id=1)"])
    assert jaccard.link_components(documents([])).count() == 0


def near(prose, words=60):
    """A text and the same with its last word exchanged."""
    text = prose(words)
    return text, text.rsplit(" ", 1)[0] + " zzz"


def component_of(docs):
    return {(r["doc_id"], r["component_id"]) for r in jaccard.link_components(docs).collect()}


def test_jaccard_null_id_before_near_copies(documents, prose):
    text, other = near(prose)
    docs = documents([(None, text), (1, text), (2, other)]).coalesce(1).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    assert component_of(docs) == {(None, None), (1, 1), (2, 1)}


def test_jaccard_texts_of_one_id(documents, prose, monkeypatch):
    (text, other), (far, further) = near(prose), near(prose, 400)
    rows = [(5, text), (5, far), (6, other), (8, prose(90)), (8, prose(70)), (9, None), (9, ""), (10, text + " x")]
    assert component_of(documents(rows, parts=1)) == {(5, 5), (6, 5), (8, 8), (9, 9), (10, 5)}
    rows += [(3, further), (8, further), (None, further), (5, text)]
    want = {(3, 3), (5, 3), (6, 3), (8, 3), (9, 9), (10, 3), (None, None)}
    assert component_of(documents(rows)) == want
    monkeypatch.setattr("talkgrain.llm.components.BROADCAST_ROWS", 0)
    assert component_of(documents(rows)) == want


def test_one_of_each_group_stays(documents, prose):
    rows = fixture(prose)
    best = {c for _, _, c in brute.jaccard(rows)}
    docs = documents(rows)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(best)


@pytest.mark.parametrize("group_rows", [None, 2])
def test_bytes(documents, prose, group_rows):
    rows = fixture(prose)
    got = suffixes.dedup_bytes(documents(rows), group_rows=group_rows)
    assert sorted(map(tuple, got.collect())) == sorted(brute.bytes_dedup(rows, 200))


def test_bytes_short_windows_in_small_slices(documents, prose, monkeypatch):
    rows = fixture(prose)
    monkeypatch.setattr(repeats, "TOGETHER", 7)
    monkeypatch.setattr("talkgrain.llm.components.BROADCAST_ROWS", 2)
    got = suffixes.dedup_bytes(documents(rows, parts=5), length=30, sample=9, group_rows=9)
    assert sorted(map(tuple, got.collect())) == sorted(brute.bytes_dedup(rows, 30))


@pytest.mark.parametrize("group_rows", [None, 2])
def test_words(documents, prose, group_rows):
    rows = fixture(prose)
    got = substrings.dedup_words(documents(rows), group_rows=group_rows)
    assert sorted(map(tuple, got.collect())) == sorted(brute.words_dedup(rows, 35))


def test_words_short_windows(documents, prose):
    rows = fixture(prose)
    got = substrings.dedup_words(documents(rows, parts=5), length=8, sample=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute.words_dedup(rows, 8))


@pytest.mark.parametrize("run", [suffixes.dedup_bytes, substrings.dedup_words])
def test_null_ids_and_empty(documents, run):
    long = "many different words stand in this text " * 1 + " ".join(map(str, range(80)))
    got = run(documents([(None, long), (None, long), (None, None), (4, "x")])).collect()
    assert sorted(r["n_removed"] > 0 for r in got) == [False, False, True, True]
    assert run(documents([])).count() == 0


def test_documents_keep_their_columns(documents, prose):
    rows = fixture(prose)
    docs = documents(rows)
    done = suffixes.deduplicated(docs)
    assert done.columns == docs.columns
    want = {i: (n, gone) for i, n, gone, *_ in brute.bytes_dedup(rows, 200)}
    for r in done.collect():
        assert len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1]
        assert r["n_chars"] == len(r["text"]) and r["rest"] == "x"


def test_cut_characters_are_left_out(documents):
    shared = "é" * 150
    done = suffixes.deduplicated(documents([(1, "a" + shared + "ü"), (2, "è" + shared + "b")]))
    assert {r["doc_id"]: r["text"] for r in done.collect()} == {1: "aü", 2: "èb"} or all(
        "�" not in r["text"] for r in done.collect())


def test_hot_keys_join_by_broadcast(documents, prose, monkeypatch):
    rows = fixture(prose)
    monkeypatch.setattr("talkgrain.llm.components.HOT_ROWS", 3)
    got = jaccard.link_components(documents(rows))
    assert sorted(map(tuple, got.collect())) == brute.jaccard(rows)
    got = suffixes.dedup_bytes(documents(rows))
    assert sorted(map(tuple, got.collect())) == sorted(brute.bytes_dedup(rows, 200))


def test_many_equal_rows(documents, prose):
    text = prose(60)
    rows = [(k, text) for k in range(300)] + [(400, prose(60))]
    got = jaccard.link_components(documents(rows)).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 300} == {0}
    gone = {r["doc_id"]: r["n_removed"] for r in suffixes.dedup_bytes(documents(rows)).collect()}
    assert all(gone[k] == len(text) for k in range(300)) and gone[400] == 0
