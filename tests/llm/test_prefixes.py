"""Prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

from talkgrain.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved, todo = 0, 0, [p]
        while todo:
            q = todo.pop()
            leaves += q not in children
            saved += (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
            todo += children.get(q, [])
        return leaves, saved

    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), *below(p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def check(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr(
        "*", "'x' as a", "'x' as b", "'x' as c", "'x' as j", "'x' as at", "'x' as n", "'x' as piece", "'x' as size")
    got = prefixes.conversation_trie(table)
    assert got.columns == COLUMNS
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(rows)


def drawn(seed, convs, words, most):
    rng = random.Random(seed)
    return [(c, t, rng.choice("us"), rng.choice(words)) for c in range(convs) for t in range(rng.randint(1, most))]


def test_few_texts_long_shared_prefixes(spark):
    rows = drawn(1, 40, ["a", "é"], 14)
    shared = [(100 + c, t, "u", f"turn {t}" if t < 9 or c % 3 else f"other {c}") for c in range(12) for t in range(10 + c % 2)]
    check(spark, rows + shared)


def test_hot_first_turn_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 2)
    monkeypatch.setattr(prefixes, "CHUNK", 3)
    copies = [(5 * c, t, "u", f"same {t}") for c in range(60) for t in range(6)]
    first = [(5 * c + 1, t, "u", "same 0" if t == 0 else f"own {c} {t}") for c in range(60) for t in range(3)]
    check(spark, copies + first + [(1000, t, "s", f"long {t}") for t in range(200)]
          + [(1001, t, "s", "x") for t in range(3)])


def test_nulls_empty_texts_ties_and_missing_turns(spark):
    rows = [(None, 0, "u", "lost"), (3, None, None, None), (3, 0, "u", ""), (3, 0, "u", ""), (7, 1, "u", "x"), (7, None, "s", "y"),
            (8, 5, None, "x"), (-4, 0, "u", "minus"), (-4, 1, "u", "four"), (-1, 0, "u", "m" * 300_000), (12, 0, "ab", "c"),
            (13, 0, "a", "bc")] + [(c, 0, "u", "only") for c in range(20, 30)]
    check(spark, rows)


def test_empty(spark):
    assert prefixes.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
