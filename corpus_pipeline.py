"""From raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns documents; between stages they are written as
Parquet and read again. The last stage returns the mix: the documents it takes, with ``size`` and
``source_size`` in words, the source's ``target`` and the words ``taken`` from each document.

Every row is judged by its own text: rows without doc_id, and several texts of one doc_id, are told apart
for each stage that decides by id (``llm.nodes``) and keep their ids. Rows equal in id and text are one
document and decided on alike. Null texts are empty, an empty table gives an empty mix, columns beyond
those of documents are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkgrain.llm import decontam, jaccard, mixing, quality, suffixes
from talkgrain.llm.nodes import own_ids, told_apart
from talkgrain.plans.scratch import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return own_ids(quality.good_documents(told_apart(docs), _table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return own_ids(jaccard.representatives(told_apart(docs)))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte runs that occur more than once."""
    return suffixes.deduplicated(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return own_ids(decontam.decontaminated(told_apart(docs), _table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("suffix_dedup", unrepeated),
    ("decontamination", untested),
    ("mixing", mixed),
]

#: Classifier, byte runs and near duplicates are beyond SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
