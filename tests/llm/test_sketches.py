"""Fingerprints against sets of shingle hashes."""

import hashlib
import re
import string
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from talkgrain.llm import sketches

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    out = set()
    for k in range(max(len(words) - 4, min(len(words), 1))):
        h = 42
        for w in words[k:k + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", zlib.crc32(w.encode())), seed=h)
        out.add(h >> 16)
    return out


def printed(hashes, k=sketches.K):
    return "".join(f"{h:012x}" for h in sorted(hashes)[:k])


def near(a, b, k=sketches.K):
    if a == b:
        return 1.0
    x, y = set(sorted(a)[:k]), set(sorted(b)[:k])
    union = x | y if len(x) < k and len(y) < k else set(sorted(x | y)[:k])
    return len(x & y & union) / len(union)


def expected(rows, order):
    out = []
    line = sorted(rows, key=order)
    for (i, t), (_, nxt) in zip(line, line[1:] + line[:1], strict=True):
        t, nxt = t or "", nxt or ""
        n = len(t)
        edited = t[:n - n // 2] + nxt[:n // 2]
        a, b, c = shingles(t), shingles(edited), shingles(nxt)
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), near(a, b), near(a, c)))
    return sorted(map(repr, out))


def check(documents, rows, order):
    got = sketches.edited_fingerprints(documents(rows))
    assert got.columns == COLUMNS
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(rows, order)


def test_edited_texts(documents, prose, monkeypatch):
    monkeypatch.setattr(sketches, "RUN", 50)
    rng = prose.rng
    rows = [(k * 3, prose(rng.choice([0, 1, 2, 4, 5, 6, 40, 200, 700]))) for k in range(30)]
    same = prose(300)
    rows += [(200, same), (201, same), (202, same.upper() + "\t\n tail é"), (203, "Ü é ß 𝔘𝔫 𝔦 " * 60), (204, None), (205, ""), (206, " \n "),
             (207, "lone"), (208, " ".join(f"w{k}" for k in range(20_000)))]
    check(documents, rows, lambda r: r[0])


def test_repeated_and_null_ids(spark, documents, prose):
    texts = [prose(30), prose(60), "", prose(9)]
    h = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.xxhash64("t").alias("h")).collect()}
    rows = [(5, texts[0])] * 7 + [(5, texts[1]), (5, ""), (5, None), (None, texts[3]), (None, texts[1]), (None, None), (6, texts[0])]
    check(documents, rows, lambda r: (r[0] is not None, r[0] or 0, h[r[1] or ""]))


def test_one_row_and_none(documents, prose):
    check(documents, [(1, prose(50))], lambda r: r[0])
    assert sketches.edited_fingerprints(documents([])).collect() == []


def test_merge_and_estimates(spark, documents, prose):
    words = [prose(1) + str(k) for k in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    rows = documents([(1, a), (2, b), (3, " ".join(words)), (4, "")])
    prints = sketches.fingerprints(rows)
    f = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    row = spark.createDataFrame([(f[1], f[2], "")], "a string, b string, e string").select(
        sketches.merged(F.col("a"), F.col("b")).alias("ab"), sketches.merged(F.col("a"), F.col("e")).alias("ae"),
        sketches.resemblance(F.col("a"), F.col("b")).alias("near"), sketches.containment(F.col("a"), F.col("b")).alias("part"),
        sketches.distinct_shingles(F.col("a")).alias("n"), sketches.resemblance(F.col("e"), F.col("e")).alias("same"),
        sketches.resemblance(F.col("a"), F.col("e")).alias("none"), sketches.containment(F.col("e"), F.col("a")).alias("of_none"),
        sketches.distinct_shingles(F.col("e")).alias("zero")).first()
    assert row["ab"] == printed(shingles(a) | shingles(b)) and row["ae"] == f[1]
    assert row["near"] == near(shingles(a), shingles(b)) == pytest.approx(1 / 3, abs=0.13)
    assert row["part"] == pytest.approx(0.5, abs=0.2) and row["n"] == pytest.approx(1996, rel=0.3)
    assert (row["same"], row["none"], row["of_none"], row["zero"]) == (1.0, 0.0, None, 0.0)
    groups = prints.withColumn("g", F.when(F.col("doc_id") < 3, F.lit("ab"))).withColumn("h", F.lit(None).cast("string"))
    got = {r["g"]: r["fingerprint"] for r in sketches.merged_by(groups, ["g", "h"], "fingerprint").collect()}
    assert got == {"ab": row["ab"], None: f[3]}


def test_estimates_stay_near_the_truth(documents, prose):
    base = [prose(1) + str(k) for k in range(1500)]
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        keep = 1500 - 30 * k
        rows.append((k, " ".join(base[:keep] + [f"new{k}x{j}" for j in range(1500 - keep)])))
    prints = {r["doc_id"]: r["fingerprint"] for r in sketches.fingerprints(documents(rows)).collect()}
    off = []
    for k in range(1, 40):
        x, y = shingles(rows[0][1]), shingles(rows[k][1])
        off.append(near(x, y) - len(x & y) / len(x | y))
        assert prints[k] == printed(y)
    assert max(map(abs, off)) < 0.17 and abs(sum(off)) / len(off) < 0.06
