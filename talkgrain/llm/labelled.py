"""Labelled documents: bounded samples, and all of them in parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A longer text is scored like any other but not part of a sample.
LEARN_BYTES = 20_000
#: Labelled ids are broadcast up to so many; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def fold(doc_id: Column) -> Column:
    """0 to 4; rows of fold 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and y (0 or 1, the larger of several) of labelled rows that are not held out."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("y"))
    return rows.where("doc_id is not null and y is not null").where(fold(F.col("doc_id")) != 0).groupBy(
        "doc_id").agg(F.greatest(F.lit(0), F.least(F.lit(1), F.max("y"))).alias("y"))


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most ``per_class`` rows of each class, first by a hash of the id, and how
    many labelled rows each class has."""
    rows = labelled(labels, column)
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= LEARN_BYTES)
    # One row per id: 2 * per_class ids at most, so the list is broadcast.
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("y").alias("y")), totals


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and, for each row, how many labelled rows of its class it stands for."""
    rows, totals = labelled_texts(docs, labels, column, per_class)
    got = rows.orderBy("doc_id").toArrow()
    y = got.column("y").to_numpy().astype(np.int64)
    seen = np.bincount(y, minlength=2)
    weight = np.array([totals.get(k, 0) / max(1, seen[k]) for k in (0, 1)])
    return got.column("text").to_pylist(), y, weight[y] if len(y) else np.zeros(0)


def parted_texts(docs: DataFrame, labels: DataFrame, column: str, per_part: int, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(part, doc_id, text, y) of all labelled rows that are not held out, texts of any length, and how many
    labelled rows each class has. Parts have some ``per_part`` ids each, or more where that would be over
    ``most`` parts; a part is one partition, in an order of its own that depends on ids and texts alone."""
    rows = labelled(labels, column)
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(totals.values())
    parts = max(1, min(most, -(-n // per_part)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(rows) if n <= BROADCAST_IDS else rows, "doc_id").select(
        F.expr(f"pmod(hash(doc_id), {parts})").alias("part"), "doc_id", "text", "y")
    return joined.repartitionById(parts, F.col("part")).sortWithinPartitions(
        F.xxhash64("doc_id"), "doc_id", "text"), totals


def once_each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    """(text, y) of each id of a part, the first text of several."""
    last = None
    for batch in batches:
        for doc_id, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True):
            if doc_id != last:
                last = doc_id
                yield text, y
