from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.append(os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) rows, in several partitions."""
    def make(rows, extra=True, parts=3):
        full = [(i, t, "en", f"src{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        if extra:  # names that the operators use inside
            for c in ("id", "h", "row", "gram", "n", "rest", "runs", "node", "component", "_id", "size"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make


@pytest.fixture
def prose():
    """Text of so many words, from a small vocabulary."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(3000)]

    def make(n):
        return " ".join(rng.choice(words) for _ in range(n))

    make.rng = rng
    return make
