"""Search for similar vectors over a stored index of hash buckets.

The index holds unit vectors in buckets, one directory each. A bucket is a row of bits: on which side of
each of a few planes a vector lies. The planes are at right angles to each other, point along the directions
in which a bounded sample spreads most, and pass through its middle, so near vectors tend to share a bucket
and buckets are of like size. One index has its planes for each length of vectors.

A query's distance from the planes bounds its similarity to whatever lies beyond them: for unit vectors at
least the squared distances to all planes between a query and a bucket separate it from the bucket's vectors,
so ``1 - sum / 2`` is the most similar that one of them can be. A search reads the buckets nearest by that bound
(``probes`` for each query). The exact search then reads those, and only those, whose bound reaches the ``k``-th
best found so far.

All queries of a batch go through one pass: each task reads buckets that some query asks for, multiplies
their vectors with the asking queries, and keeps the best ``k`` of each. Vectors are never shuffled.

Null, empty and zero vectors, and those with null or non-finite components, are neither stored nor searched
for. Vectors are scaled by their largest component first, so very small and very large ones count as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgrain.plans.scratch import stored
from talkgrain.plans.ship import ship_package

#: Vectors of each length that the planes are fitted on, first by a hash of the id.
SAMPLE = 5_000
#: Queries of one pass; more are searched for pass by pass.
BATCH = 2_000
MOST_BITS = 12


def usable(vectors: DataFrame, key: str) -> DataFrame:
    """(key, v): the vectors that have a direction, as doubles with largest component 1."""
    rows = vectors.select(key, F.col("embedding").cast("array<double>").alias("v")).where(
        "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    rows = rows.withColumn("top", F.array_max(F.transform("v", F.abs))).where("top > 0")
    return rows.select(key, F.transform("v", lambda x: x / F.col("top")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def fit_planes(rows: DataFrame, key: str, dim: int, bits: int, sample: int = SAMPLE) -> dict:
    """Directions (bits x dim, orthonormal) and offsets of the planes for vectors of one length."""
    own = rows.where(F.size("v") == dim).orderBy(F.xxhash64(F.col(key)), key).limit(sample)
    x = _matrix(own.toArrow().column("v").combine_chunks(), dim)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=True)
    axes = axes[:min(bits, dim)]
    # Turned among themselves, the directions share what the sample's first few would have alone.
    turn, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(len(axes), len(axes))))
    axes = turn @ axes
    return {"dim": dim, "axes": axes.tolist(), "offsets": np.median(x @ axes.T, axis=0).tolist()}


def _bucketed(planes: list[dict], key: str):
    known = {p["dim"]: (np.array(p["axes"]), np.array(p["offsets"])) for p in planes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = rows.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                part = rows.filter(pa.array(sizes == dim))
                x = _matrix(part.column("v"), int(dim))
                axes, offsets = known[int(dim)]
                bucket = (x @ axes.T >= offsets) @ (1 << np.arange(len(offsets)))
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), unit, pa.array(np.full(len(x), dim, np.int32)), pa.array(bucket.astype(np.int32))],
                    names=[key, "v", "dim", "bucket"])

    return run


def write_index(vectors: DataFrame, path: str, *, bits: int = 8, key: str = "vec_id", sample: int = SAMPLE) -> None:
    """Store the vectors (key, embedding) as an index in the new folder ``path``."""
    if not 1 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be from 1 to {MOST_BITS}")
    spark = vectors.sparkSession
    rows = usable(vectors, key)
    dims = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    planes = [fit_planes(rows, key, dim, bits, sample) for dim in sorted(dims)]
    spark.createDataFrame([(json.dumps(p),) for p in planes], "planes string").coalesce(1).write.text(f"{path}/planes")
    add_vectors(vectors, path, key=key)


def _planes(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r["value"]) for r in spark.read.text(f"{path}/planes").collect()]


def add_vectors(vectors: DataFrame, path: str, *, key: str = "vec_id") -> None:
    """Add vectors to an index, by its planes; vectors of a length that it has no planes for are not added."""
    spark = vectors.sparkSession
    ship_package(spark)
    planes = _planes(spark, path)
    kind = dict(vectors.dtypes)[key]
    rows = usable(vectors, key).withColumn("dim", F.size("v")).where(F.col("dim").isin([p["dim"] for p in planes]))
    found = rows.mapInArrow(_bucketed(planes, key), f"{key} {kind}, v array<double>, dim int, bucket int")
    # A bucket of any size is written by many tasks, a task writes few buckets.
    spread = F.pmod(F.xxhash64(key), F.lit(8))
    found.repartition("dim", "bucket", spread).write.mode("append").partitionBy("dim", "bucket").parquet(f"{path}/vectors")


class _Asked:
    """The queries of one pass and length: unit vectors, and for each the buckets by what keeps it from them."""

    def __init__(self, ids: list, x: np.ndarray, planes: dict):
        self.ids, self.x, self.dim = ids, x, planes["dim"]
        beyond = x @ np.array(planes["axes"]).T - np.array(planes["offsets"])
        buckets = np.arange(1 << beyond.shape[1])
        sides = (buckets[:, None] >> np.arange(beyond.shape[1])) & 1
        self.gaps = (beyond ** 2 * (beyond < 0)) @ sides.T + (beyond ** 2 * (beyond >= 0)) @ (1 - sides).T

    def nearest_buckets(self, probes: int) -> np.ndarray:
        """Which buckets each query asks for: the ``probes`` with the smallest gaps."""
        rank = np.argsort(np.argsort(self.gaps, axis=1, kind="stable"), axis=1)
        return rank < probes

    def reaching(self, least: np.ndarray) -> np.ndarray:
        """Which buckets may hold a vector at least as similar as ``least``, by query."""
        return 1 - self.gaps / 2 >= least[:, None] - 1e-9


def _best(x: np.ndarray, asked: np.ndarray, dim: int, k: int, key: str):
    """The ``k`` best vectors of a task for every query that asks for their bucket."""
    def cut(at: np.ndarray, ids: np.ndarray, near: np.ndarray):
        order = np.lexsort((ids, -near, at))
        at, ids, near = at[order], ids[order], near[order]
        first = np.searchsorted(at, at, side="left")
        keep = np.arange(len(at)) - first < k
        return at[keep], ids[keep], near[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for rows in batches:
            ids = rows.column(key).to_numpy(zero_copy_only=False)
            buckets = rows.column("bucket").to_numpy(zero_copy_only=False)
            vectors = np.asarray(rows.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
            for bucket in np.unique(buckets):
                here, who = np.flatnonzero(buckets == bucket), np.flatnonzero(asked[:, bucket])
                if not len(who):
                    continue
                near = vectors[here] @ x[who].T
                level = np.partition(near, len(here) - k, axis=0)[len(here) - k] if len(here) > k else -np.inf
                row, query = np.nonzero(near >= level)
                found = cut(who[query], ids[here[row]], near[row, query])
                best = found if best is None else cut(*(np.concatenate(p) for p in zip(best, found, strict=True)))
        if best is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(best[0].astype(np.int32)), pa.array(best[1]), pa.array(best[2])], names=["at", key, "similarity"])

    return run


def _scanned(spark: SparkSession, path: str, asked: _Asked, mask: np.ndarray, k: int, key: str) -> DataFrame:
    """(at, key, similarity) of the best vectors in the buckets that ``mask`` names for each query."""
    vectors = spark.read.parquet(f"{path}/vectors")
    kind = dict(vectors.dtypes)[key]
    wanted = [int(b) for b in np.flatnonzero(mask.any(axis=0))]
    rows = vectors.where(F.col("dim") == asked.dim).where(F.col("bucket").isin(wanted))
    return rows.select(key, "v", "bucket").mapInArrow(
        _best(asked.x, mask, asked.dim, k, key), f"at int, {key} {kind}, similarity double")


def _top(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("at").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, *, probes: int = 16, exact: bool = False,
           key: str = "vec_id") -> DataFrame:
    """(query_id, rank, key, similarity): the ``k`` vectors of the index most similar to each query (query_id,
    embedding), by cosine, then by key. Each query reads ``probes`` buckets; ``exact`` reads on until no
    unread bucket can hold a better vector. Queries of a length without planes find nothing."""
    ship_package(spark)
    planes = {p["dim"]: p for p in _planes(spark, path)}
    kind = dict(queries.dtypes)["query_id"]
    key_kind = dict(spark.read.parquet(f"{path}/vectors").dtypes)[key]
    found = spark.createDataFrame([], f"query_id {kind}, rank int, {key} {key_kind}, similarity double")
    asking = usable(queries, "query_id").withColumn("dim", F.size("v")).where(F.col("dim").isin(list(planes)))
    asking = stored(asking.withColumn("pass", F.expr(f"(row_number() over (partition by dim order by query_id) - 1) div {BATCH}")),
                    "vector-queries")
    for dim, turn in sorted((r["dim"], r["pass"]) for r in asking.select("dim", "pass").distinct().collect()):
        batch = asking.where((F.col("dim") == dim) & (F.col("pass") == turn)).orderBy("query_id").toArrow()
        asked = _Asked(batch.column("query_id").to_pylist(), _matrix(batch.column("v").combine_chunks(), dim), planes[dim])
        mask = asked.nearest_buckets(probes)
        top = _top(_scanned(spark, path, asked, mask, k, key), k, key)
        if exact:
            top = stored(top, "vector-first")
            least = np.full(len(asked.ids), -np.inf)
            for r in top.where(F.col("rank") == k).select("at", "similarity").collect():
                least[r["at"]] = r["similarity"]
            rest = asked.reaching(least) & ~mask
            if rest.any():
                more = _scanned(spark, path, asked, rest, k, key)
                top = _top(top.drop("rank").unionByName(more), k, key)
        names = spark.createDataFrame(list(enumerate(asked.ids)), f"at int, query_id {kind}")
        found = found.unionByName(top.join(names, "at").select("query_id", "rank", key, "similarity"))
    return found


def probes_for(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, *, recall: float = 0.95,
               key: str = "vec_id") -> int:
    """The fewest probes, by doubling, with which the given queries find the share ``recall`` of their ``k``
    most similar vectors."""
    whole = stored(search(spark, path, queries, k, exact=True, key=key).select("query_id", key), "vector-truth")
    wanted = whole.count()
    most = max((1 << len(p["offsets"]) for p in _planes(spark, path)), default=1)
    probes = 1
    while probes < most:
        got = search(spark, path, queries, k, probes=probes, key=key).join(whole, ["query_id", key], "left_semi").count()
        if got >= recall * wanted:
            break
        probes *= 2
    return min(probes, most)
