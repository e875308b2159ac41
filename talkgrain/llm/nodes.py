"""Ids under which every text is judged by itself."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.components import among
from talkgrain.plans.scratch import stored

#: The column that holds a row's own doc_id meanwhile.
OWN = "_own_doc_id"


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with their own doc_id in ``OWN`` and in doc_id a number that only rows of the same id and text
    share: the id itself, or where the id is null or has several texts a number made of both. Few ids are
    so; no text is shuffled where none is."""
    docs = docs.withColumn(OWN, F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select("doc_id", F.xxhash64(text).alias("h")).groupBy("doc_id").agg(
        F.min("h").alias("a"), F.max("h").alias("b"))
    odd = stored(keys.where("doc_id is null or a <> b").select("doc_id"), "nodes-odd")
    if odd.isEmpty():
        return docs
    named = docs.where("doc_id is not null")
    plain, several = among(named, "doc_id", odd, "doc_id", "left_anti"), among(named, "doc_id", odd, "doc_id")
    apart = several.unionByName(docs.where("doc_id is null"))
    ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    for salt in itertools.count():
        node = F.xxhash64(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(text, 256))
        made = stored(apart.select(node.alias("node"), F.col("doc_id").alias("of"), F.sha2(text, 256).alias("h")).distinct(),
                      "nodes-made")
        if made.join(ids, made["node"] == ids["id"], "left_semi").isEmpty() and made.groupBy("node").count().where(
                "count > 1").isEmpty():
            return plain.unionByName(apart.withColumn("doc_id", node))


def own_ids(docs: DataFrame) -> DataFrame:
    """The rows of :func:`told_apart`, or some of them, with their own doc_id again."""
    return docs.withColumn("doc_id", F.col(OWN)).drop(OWN)
