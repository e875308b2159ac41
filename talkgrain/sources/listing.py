"""Listing and reading folders of very many files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
OPEN_COST = "spark.sql.files.openCostInBytes"
#: What opening a small file counts as when files are dealt to tasks; by default 4 MB, so a task of 16 MB has 4 files.
SMALL_FILE = 1 << 16


def most_tasks(spark: SparkSession) -> int:
    return max(32, 4 * spark.sparkContext.defaultParallelism)


@contextmanager
def listed_by_cores(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks per core, each for many folders. By default a task takes one folder, up
    to 10,000 tasks, and starting them takes far longer than the listing. A stream started within keeps this."""
    held = spark.conf.get(TASKS)
    spark.conf.set(TASKS, str(min(int(held), most_tasks(spark))))
    try:
        yield
    finally:
        spark.conf.set(TASKS, held)


@contextmanager
def read_by_cores(spark: SparkSession) -> Iterator[None]:
    """Small files are read many to a task: what is read within, or by a stream started within, counts opening
    one as :data:`SMALL_FILE` bytes."""
    held = spark.conf.get(OPEN_COST)
    spark.conf.set(OPEN_COST, str(SMALL_FILE))
    try:
        with listed_by_cores(spark):
            yield
    finally:
        spark.conf.set(OPEN_COST, held)
