"""Benchmark decontamination: substitutions, cases, plans."""

import duckdb
import pytest

from talkgrain.llm import decontam
from talkgrain.llm.oracle import LLM_ORACLE


def items(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, doc_id string")


def test_planted(spark, documents, prose):
    item = prose(40).split(" ")
    changed = [w if k % 9 else "zzz" for k, w in enumerate(item)]
    part = item[10:24]
    noise = [w if k % 2 else "zzz" for k, w in enumerate(item)]
    rows = [(1, prose(50)), (2, prose(30) + " " + " ".join(item).upper() + "\n" + prose(30)),
            (3, prose(9) + " " + " ".join(changed) + " " + prose(400)), (4, " ".join(part)),
            (5, prose(20) + " " + " ".join(noise) + " " + prose(20)), (6, None), (7, ""), (8, " ".join(item[:10])),
            (None, " ".join(item)), (2, "short"), (9, prose(20000) + " " + " ".join(item))]
    bench = items(spark, [(70, " ".join(item)), (71, None), (72, "too short"), (None, " ".join(item)), (73, prose(30))])
    got = decontam.contamination(documents(rows), bench)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    found = [(r["doc_id"], r["n_items"], r["first_item"], r["contaminated"]) for r in got.collect()]
    want = [(i, int(i in (2, 3, 4, 9)), 70 if i in (2, 3, 4, 9) else -1, i in (2, 3, 4, 9)) for i, _ in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    kept = decontam.decontaminated(documents(rows), bench)
    assert kept.columns == documents(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "5", "6", "7", "8", "None"])


def test_shuffled_benchmark(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    item = prose(40)
    got = decontam.contamination(documents([(1, prose(50)), (2, prose(5) + " " + item)]), items(spark, [(1, item)]))
    assert {r["doc_id"]: r["contaminated"] for r in got.collect()} == {1: False, 2: True}


def test_empty(spark, documents):
    none = items(spark, [])
    assert [r["contaminated"] for r in decontam.contamination(documents([(1, "a " * 30)]), none).collect()] == [False]
    assert decontam.contamination(documents([]), items(spark, [(1, "a " * 30)])).count() == 0


def best_stretch(item, doc):
    """The most agreeing tokens of a stretch between two hits that agrees on 70%, by trying all."""
    best = 0
    for shift in range(-len(item), len(doc)):
        same = [0 <= t + shift < len(doc) and w == doc[t + shift] for t, w in enumerate(item)]
        hit = [j for j in range(len(item) - 10) if 0 <= j + shift <= len(doc) - 11
               and any(all(same[j + o] for o in m) for m in decontam.MASKS)]
        for n, p in enumerate(hit):
            for q in hit[n:]:
                agreed = sum(same[p:q + 11])
                if 100 * agreed >= 70 * (q + 11 - p):
                    best = max(best, agreed)
    return best


def test_parts_of_an_item(spark, documents, prose):
    item = prose(59).split(" ")
    halves = item[:20] + ["zzz"] * 19 + item[39:]
    chance = [w if k < 20 or k in (48, 49, 50, 52, 54, 55, 58) else "zzz" for k, w in enumerate(item)]
    near = item[:12] + [w if k % 11 in (1, 2, 4, 6, 7, 8, 0) else "zzz" for k, w in enumerate(item[12:])]
    rows = [(1, " ".join(halves)), (2, prose(7) + " " + " ".join(chance)), (3, " ".join(near)),
            (4, " ".join(item)), (5, prose(80))]
    for k in range(60):  # words replaced at changing rates
        rates = [prose.rng.choice((0, 0, 0.2, 0.4, 0.9)) for _ in range(8)]
        rows.append((10 + k, prose(k % 4) + " " + " ".join(
            "zzz" if prose.rng.random() < rates[t // 8] else w for t, w in enumerate(item))))
    got = decontam.contamination(documents(rows), items(spark, [(7, " ".join(item))])).collect()
    want = {i: best_stretch(item, t.split()) for i, t in rows}
    assert {r["doc_id"]: r["matched"] for r in got} == want
    assert want[1] == 20 and want[2] == 20 and want[4] == 59 and want[5] == 0
    assert all(r["contaminated"] == (want[r["doc_id"]] > 0) for r in got)


def by_sql(docs, bench):
    with duckdb.connect() as db:
        db.register("documents", docs.toPandas())
        db.register("benchmark", bench.toPandas())
        return db.sql(LLM_ORACLE["op9_decontamination"]).fetchall()


def test_sql_states_the_rule(spark, documents, prose):
    item, other = prose(59).split(" "), prose(20).split(" ")
    short = item[30:40]
    rows = [(1, " ".join(item[:20] + ["zzz"] * 19 + item[39:])), (2, prose(40)), (3, " ".join(short)),
            (4, prose(5) + " " + " ".join(short[:9])), (5, " ".join(other)), (6, ""), (7, None)]
    for k in range(40):
        rates = [prose.rng.choice((0, 0, 0.2, 0.4, 0.9)) for _ in range(8)]
        rows.append((10 + k, prose(k % 4) + " " + " ".join(
            "zzz" if prose.rng.random() < rates[t // 8] else w for t, w in enumerate(item))))
    docs = documents(rows)
    bench = items(spark, [(7, " ".join(item)), (8, " ".join(other)), (9, " ".join(short)), (10, short[4]), (11, None)])
    got = decontam.contamination(docs, bench).collect()
    assert sorted(map(tuple, got)) == sorted(by_sql(docs, bench))
    assert {r["doc_id"]: (r["matched"], r["first_item"]) for r in got if r["doc_id"] in (1, 3, 5, 6)} == {
        1: (20, 7), 3: (10, 9), 5: (20, 8), 6: (0, -1)}


@pytest.mark.parametrize("rows", [500_000, 1])
def test_short_items(spark, documents, prose, monkeypatch, rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    ten, three = prose(10).split(" "), ["What", "is\tthis", "thing?"]
    texts = [(1, prose(300) + " " + " ".join(ten).upper() + "\n" + prose(3)), (2, " ".join(ten[:9])),
             (3, " ".join(ten[:4] + ["zzz"] + ten[5:])), (4, "what  IS this thing?"), (5, "this thing? is what"),
             (6, "what is this thing? " * 500), (7, None), (8, ""), (None, " ".join(ten)), (1, prose(8)),
             (9, " ".join(ten[:5]) + " and " + " ".join(ten[5:])), (10, prose(15) + " " + " ".join(ten + ten))]
    bench = items(spark, [(70, " ".join(ten)), (71, " ".join(three)), (72, " "), (None, " ".join(ten)), (73, "unsaid"),
                          (74, prose(30)), (70, " ".join(ten))])
    got = decontam.contamination(documents(texts), bench)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    hit = {1: (1, 10, 70), 10: (1, 10, 70), 4: (1, 4, 71), 6: (1, 4, 71)}
    want = [(i, *hit.get(i, (0, 0, -1)), i in hit) for i, _ in texts]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = decontam.decontaminated(documents(texts), bench).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(map(str, (2, 3, 5, 7, 8, 9, None)))
    only = decontam.short_matches(documents(texts), bench, shortest=5).collect()
    assert {r["item_id"] for r in only} == {70}
    assert decontam.short_matches(documents(texts), items(spark, [(1, prose(11))])) is None
