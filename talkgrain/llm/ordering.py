"""Ranks in one global order, without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.plans.scratch import stored


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the 0-based rank in its group, and ``size``, the rows of the group.

    Rows are dealt by ranges of (group, order), so a hot group spreads over many tasks; each range is
    ranked for itself and starts at the rows of its group in earlier ranges, of which there is one
    count per range. Rows equal in ``order`` are told apart by their place in the table. ``group`` is
    not null; nulls in ``order`` come first.
    """
    keys = [group, *order, "_place"]
    dealt = stored(rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn(
        "_range", F.spark_partition_id()), name)
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_range")
    whole = Window.partitionBy(group)
    starts = counts.select(group, "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(whole).alias("size"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, "_place"))
    return dealt.withColumn("_at", inside).join(starts, [group, "_range"]).withColumn(
        "pos", F.col("_before") + F.col("_at") - 1).drop("_place", "_range", "_at", "_before", "_n")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
