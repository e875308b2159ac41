"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.plans.scratch import stored

#: ``among`` broadcasts a list of ids up to this many rows (some 40 MB as a hash table).
BROADCAST_ROWS = 500_000


def among(df: DataFrame, column: str, ids: DataFrame, id_column: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``column`` is (``left_anti``: is not) among the stored ids. A list
    within ``BROADCAST_ROWS`` is broadcast, a longer one joined by a shuffle."""
    ids = ids.select(F.col(id_column).alias("_id")).distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, df[column] == ids["_id"], how)


#: A key with more rows than this is joined by broadcast, and its rows stay where they are.
HOT_ROWS = 100_000
#: Parts in which a group of equal rows is gathered.
PARTS = 64


def join_counted(rows: DataFrame, counts: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows.join(counts, key, how)`` (inner or left) where the stored ``counts`` says how many rows each key has. Keys of
    more than ``HOT_ROWS`` would gather in one task each; they are few, and join by broadcast."""
    hot = counts.where(F.col(count) > HOT_ROWS)
    if not 0 < hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(counts, key, how)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(
        rest.join(counts.where(F.col(count) <= HOT_ROWS), key, how))


def equal_rows(rows: DataFrame, keys: list[str], node: str) -> DataFrame:
    """(a, b) for rows that agree in ``keys``: a row's node a with the smallest node b of its part of
    the group, and the parts' b with the group's. A group of any size is met in ``PARTS`` parts."""
    parts = rows.withColumn("_part", F.pmod(F.xxhash64(node), F.lit(PARTS)))
    low = stored(parts.groupBy(*keys, "_part").agg(F.min(node).alias("b"), F.count("*").alias("_n")), "equal")
    least = low.groupBy(*keys).agg(F.min("b").alias("c"), F.sum("_n").alias("_all")).where("_all > 1")
    met = stored(low.join(least, keys), "equal")
    return parts.join(met, [*keys, "_part"]).select(F.col(node).alias("a"), "b").unionByName(
        met.select(F.col("b").alias("a"), F.col("c").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (a, b) to another; the component is the
    smallest node that edges reach.

    Large star: every node sends its smallest neighbour to its larger neighbours. Small star: every
    node sends its smallest neighbour to its smaller ones. No step gathers a node's neighbours; the
    edges become stars around the smallest nodes in a logarithmic number of rounds.
    """
    links = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select("a", "b", "m")
        links = stored(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            moved.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
