"""Merkle manifest against a plain tree over lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from talkgrain.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [*row[:4], row[4] if text is None else text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    """The root, and for each node the siblings left and right, level by level."""
    beside, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            first = at - at % 3
            beside[k].append((nodes[first:at], nodes[at + 1:first + 3]))
        nodes = [h(nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
        where = [at // 3 for at in where]
    return nodes[0], beside


def expected(rows, tampered):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    per = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        per[s] = own, *tree([leaf(r) for r in own])
    root, tops = tree([per[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        own, subroot, beside = per[s]
        for r, low in zip(own, beside, strict=True):
            cur = leaf(r, tampered(r))
            for left, right in low + top:
                cur = h([*left, cur, *right])
            out.append((r[0], s, leaf(r), subroot, root, h(x for a, b in low + top for x in (*a, *b)), cur, cur == root))
    return sorted(map(repr, out))


def tamper(r):
    if r[0] is None or r[4] is None or zlib.crc32(str(r[0]).encode()) % 2:
        return None
    return r[4].replace("\n", "")


def check(spark, rows, block):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr(
        "*", "'x' as tree", "'x' as block", "'x' as leaf", "'x' as pos", "'x' as size", "'x' as root")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    got = merkle.manifest(docs, changed, block=block)
    assert got.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(rows, tamper)


@pytest.mark.parametrize("block", [1, 9])
def test_trees(spark, block):
    counts = {"a": 1, "b": 2, "c": 3, "d": 4, "é": 28, "e": 82 if block > 1 else 5, None: 10, "": 9}
    rows = [(k * 7 + n, s, "en", n, f"text {n}\nof {s}" if n % 3 else "flat")
            for k, (s, c) in enumerate(counts.items()) for n in range(c)]
    check(spark, rows, block)


def test_more_sources_than_a_partition_holds(spark):
    check(spark, [(1000 + n, f"s{n}", "en", 1, "y\n") for n in range(13)], 3)


def test_nulls_ties_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "s", "en", 0, ""), (None, "s", "en", 0, "z\n"), (3, "s", None, 1, None),
            (3, "s", "en", 1, "same"), (3, "s", "en", 1, "same"), (3, "s", "en", 1, "other\n"), (4, "s", "en", 2, "\n" * 9),
            (6, "t", "de", 5, "lang \n ü " * 90_000)]
    check(spark, [(7, "s", "en", 4, "copy\n")] * 40 + rows, 3)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_any_change_breaks_the_proof(spark):
    rows = [(n, f"s{n % 4}", "en", n, f"text {n}") for n in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert all(r["verified"] for r in merkle.manifest(docs, block=3).collect())
    assert not any(r["verified"] for r in merkle.manifest(docs, F.concat("text", F.lit("!")), block=3).collect())
