"""Near-duplicate vectors by product quantisation.

Coarse centroids make inverted lists; a vector lies in the list of its nearest centroid as the codes
of its residual, one byte for each subspace. Every vector goes as a query to its own list and to those
whose border it is near: a neighbour across the border between centroids c and c' must overcome
``(d2(x, c') - d2(x, c)) / (2 d(c, c'))``, which is at most the largest linked length. How much of that
length links do overcome depends on how the vectors spread, and is measured: up to ``QUERIES`` vectors
meet all vectors by brute force, and lists are probed as far as ``RECALL`` of their links need, of all
links and of the links of each query, whichever is more. Where fewer than ``LEAST_LINKED`` queries have
a link nothing is told by them, and lists are probed over the whole length, which loses no link. In a
list, table look-ups give the asymmetric distance of a query to every code. A code stands off its vector
by a known error, so a distance beyond radius plus error proves that the pair does not link; all other
pairs are settled by the exact cosine in double precision. The only loss is what the probes miss (recall
is tested on evenly spread vectors and on some that spread in few directions).

Centroids are fitted on a bounded sample, every vector is indexed, those of each length in an index of
their own. Equal vectors are one node with a count. A task holds one tile of a list while queries stream
past, and gives back link counts and, for components, one edge per linked vector, never all pairs of a
group.

Cases: a null or zero vector, one with null or non-finite components, or without an id links with
nothing; vectors of different lengths do not link; a vector may be of any size, as it is divided by its
largest component before squares are taken, and components other than floats are read as doubles; rows
are vectors, so repeated rows with one id link with each other and count so, and different vectors under
one id count their links together; an empty table gives an empty table; only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrain.llm.components import components, join_counted
from talkgrain.plans.scratch import stored
from talkgrain.plans.ship import ship_package

COSINE = 0.95
#: Vectors that the index is fitted on; the number of lists is the root of the number of vectors, and
#: at most ``MOST_LISTS``.
SAMPLE = 20_000
MOST_LISTS = 2048
SUBSPACES = 8
CODES = 256
#: Vectors whose links are searched by brute force to measure how far lists must be probed, the part of
#: those links that the probes are to find, and the queries with a link that are needed to tell.
QUERIES = 2000
RECALL = 0.998
LEAST_LINKED = 100
#: Steps in which the part of the linked length is measured.
STEPS = 32
TILE = 2048
SENT = 8192


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the squared distances to all."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)
    return d.argmin(1), np.maximum(d, 0)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([nearest(x[a:a + 4096], centroids)[0] for a in range(0, len(x), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    #: The part of the largest linked length up to which a border is crossed.
    reach: float = 1.0

    def codes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, and how far each code stands off its vector."""
        residual = x - self.centroids[own]
        out, error, at = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x)), 0
        for k, book in enumerate(self.books):
            part = residual[:, at:at + book.shape[1]]
            out[:, k], _ = nearest(part, book)
            error += ((part - book[out[:, k]]) ** 2).sum(1)
            at += book.shape[1]
        return out, np.sqrt(error)

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the codes of one list, by table look-up."""
        residual = x - self.centroids[cell]
        total, at = np.zeros((len(x), len(codes))), 0
        for k, book in enumerate(self.books):
            part = residual[:, at:at + book.shape[1]]
            total += nearest(part, book)[1][:, codes[:, k]]
            at += book.shape[1]
        return np.sqrt(total)

    def probes(self, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list of each vector, and pairs (row, list) to probe, own list first in number order:
        of two lists only the one with the higher number is probed for the other's vectors."""
        own, d = nearest(x, self.centroids)
        step = self.reach * np.sqrt(2 - 2 * cosine)
        _, between = nearest(self.centroids, self.centroids)
        gap = d - d[np.arange(len(x)), own][:, None]
        near = gap <= 2 * step * np.sqrt(between)[own] + 1e-12
        near &= np.arange(len(self.centroids)) >= own[:, None]
        near[np.arange(len(x)), own] = True
        row, cell = np.nonzero(near)
        return own, row, cell


def fit(x: np.ndarray, lists: int, seed: int = 5) -> Index:
    rng = np.random.default_rng(seed)
    centroids = k_means(x, max(1, lists), 8, rng)
    own, _ = nearest(x, centroids)
    residual = x - centroids[own]
    cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    return Index(centroids, [k_means(residual[:, a:b], CODES, 6, rng)
                             for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def unit(lists: pa.Array, width: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _valid() -> Column:
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    return known & ~bad & F.exists("embedding", lambda v: v != 0)


def _hashes() -> Column:
    return F.struct(F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))


def nodes(vectors: DataFrame) -> DataFrame:
    """(h, node, copies, embedding): the distinct valid vectors, named by their smallest id."""
    return vectors.where(_valid()).groupBy(_hashes().alias("h")).agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))


def _needed(shared, width: int, cosine: float):
    """(query, step, links) of each batch: how many vectors link with a query of the broadcast, and the
    step of the linked length up to which the border between their lists must be probed for it."""
    radius = np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, named, queries = shared.value
        own_q, far_q = nearest(queries, index.centroids)
        between = np.sqrt(nearest(index.centroids, index.centroids)[1])
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = unit(part.column(1), width)
                p, q = np.nonzero(x @ queries.T >= cosine)
                other = part.column(0).to_numpy()[p] != named[q]
                p, q = p[other], q[other]
                own, far = nearest(x, index.centroids)
                low = own[p] < own_q[q]  # the list with the lower number asks the other
                here, there = np.minimum(own[p], own_q[q]), np.maximum(own[p], own_q[q])
                gap = np.where(low, far[p, there] - far[p, here], far_q[q, there] - far_q[q, here])
                length = 2 * radius * between[here, there]
                share = np.where(here == there, 0, gap / np.where(length > 0, length, np.inf))
                step = np.ceil(np.clip(share, 0, 1) * STEPS).astype(np.int64)
                kinds, links = np.unique(q * (STEPS + 1) + step, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds // (STEPS + 1)), pa.array(kinds % (STEPS + 1)), pa.array(links)],
                    ["query", "step", "links"])

    return run


def measured_reach(found: DataFrame, index: Index, named: np.ndarray, queries: np.ndarray, cosine: float) -> float:
    """The part of the linked length up to which lists are to be probed."""
    shared = found.sparkSession.sparkContext.broadcast((index, named, queries))
    counted = found.select("node", "embedding").mapInArrow(
        _needed(shared, queries.shape[1], cosine), "query bigint, step bigint, links bigint").groupBy(
        "query", "step").agg(F.sum("links").alias("links")).toArrow()  # at most QUERIES * (STEPS + 1) rows
    shared.destroy()
    query, step, links = (c.to_numpy() for c in counted.columns)
    if len(np.unique(query)) < LEAST_LINKED:
        return 1.0

    def enough(weight: np.ndarray) -> int:
        part = np.cumsum(np.bincount(step, weights=weight, minlength=STEPS + 1))
        return int(np.argmax(part >= RECALL * part[-1]))

    each = links / np.bincount(query, weights=links)[query]
    return max(1, enough(links), enough(each)) / STEPS


def _routed(shared, width: int, cosine: float):
    """(cell, own, standing, node, copies, embedding): each vector where it stands and is sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                own, row, cell = index.probes(unit(part.column(2), width), cosine)
                every = np.arange(len(own))
                taken = np.concatenate([every, row])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([own, cell])), pa.array(own[taken]),
                    pa.array(np.concatenate([np.ones(len(own), bool), np.zeros(len(row), bool)])),
                    *(part.column(c).take(pa.array(taken)) for c in range(3))],
                    ["cell", "own", "standing", "node", "copies", "embedding"])

    return run


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over the links (x, y)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            return root


def _linked(shared, width: int, cosine: float):
    """(node, links, root) from rows sorted by list, tile, task and standing first: links found of a
    node, and a node it is connected to."""
    radius = np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        place, parts, tile = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                part = batch.slice(a, b - a)
                if tuple(keys[a, :3]) != place:
                    place, parts, tile = tuple(keys[a, :3]), [], None
                if not keys[a, 3]:
                    parts.append(part)
                    continue
                if not parts:  # no vector stands in this tile
                    continue
                cell = int(place[0])
                if tile is None:
                    ids, copies, lists = (pa.concat_arrays([p.column(k) for p in parts]) for k in (5, 6, 7))
                    x = unit(lists, width)
                    tile = (ids.to_numpy(), copies.to_numpy(), x, *index.codes(x, np.full(len(x), cell)))
                node, copies, held, codes, error = tile
                for s in range(0, part.num_rows, 256):
                    sent = part.slice(s, 256)
                    x, ids, times = unit(sent.column(7), width), sent.column(5).to_numpy(), sent.column(6).to_numpy()
                    own = sent.column(4).to_numpy() == cell
                    maybe = index.distances(x, cell, codes) <= radius + error + 1e-9
                    maybe &= ~own[:, None] | (ids[:, None] < node)
                    p, q = np.nonzero(maybe)
                    close = np.concatenate([np.zeros(0, bool), *(
                        np.einsum("ij,ij->i", x[p[k:k + 65536]], held[q[k:k + 65536]]) >= cosine
                        for k in range(0, len(p), 65536))])
                    p, q = p[close], q[close]
                    if not len(p):
                        continue
                    both = np.concatenate([ids[p], node[q]])
                    kinds, which = np.unique(both, return_inverse=True)
                    count = np.bincount(which, weights=np.concatenate([copies[q], times[p]]))
                    root = forest(which[:len(p)], which[len(p):], len(kinds))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kinds), pa.array(count.astype(np.int64)), pa.array(kinds[root])],
                        ["node", "links", "root"])

    return run


def links_of_length(found: DataFrame, width: int, number: int, cosine: float, sample: int,
                    lists: int | None) -> DataFrame:
    """(node, links, root) of the ``number`` nodes, all of one length; a node may occur several times."""
    kind = found.schema["embedding"].dataType.simpleString()
    picked = found.orderBy(F.xxhash64("node")).limit(sample).select("node", "embedding").toArrow().combine_chunks()
    x = unit(picked.column(1).chunk(0), width)
    index = fit(x, lists or int(min(MOST_LISTS, number ** 0.5, max(1, len(x) // 8))))
    if len(index.centroids) > 1:
        index = replace(index, reach=measured_reach(
            found, index, picked.column(0).to_numpy()[:QUERIES], x[:QUERIES], cosine))
    shared = found.sparkSession.sparkContext.broadcast(index)

    routed = stored(found.select("node", "copies", "embedding").mapInArrow(
        _routed(shared, width, cosine),
        f"cell bigint, own bigint, standing boolean, node bigint, copies bigint, embedding {kind}"),
        "embed-routed")
    cells = routed.groupBy("cell").agg(
        F.expr(f"count_if(standing) div {TILE} + 1").alias("tiles"),
        F.expr(f"count_if(not standing) div {SENT} + 1").alias("tasks"))
    placed = routed.join(cells, "cell")
    seat = F.pmod(F.xxhash64("node"), F.when(F.col("standing"), F.col("tiles")).otherwise(F.col("tasks")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("standing"), F.col("tasks")).otherwise(F.col("tiles")) - 1))
    placed = placed.select("*", seat.alias("seat")).select("*", other.alias("other"))
    rows = placed.select(
        "cell", F.when(F.col("standing"), F.col("seat")).otherwise(F.col("other")).alias("tile"),
        F.when(F.col("standing"), F.col("other")).otherwise(F.col("seat")).alias("task"),
        F.when(F.col("standing"), 0).otherwise(1).cast("bigint").alias("moves"), "own", "node", "copies", "embedding")
    place = ["cell", "tile", "task"]
    links = stored(rows.repartition(*place).sortWithinPartitions(*place, "moves").mapInArrow(
        _linked(shared, width, cosine), "node bigint, links bigint, root bigint"), "embed-links")
    shared.destroy()
    return links


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE,
                    lists: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    ship_package(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(
        "array<float>" if floats else "array<double>").alias("embedding"))
    found = stored(nodes(vectors), "embed-nodes")
    widths = found.groupBy(F.size("embedding").alias("width")).count().where("count > 1").orderBy("width").collect()
    links = reduce(DataFrame.unionByName, [
        links_of_length(found.where(F.size("embedding") == width), width, number, cosine, sample, lists)
        for width, number in widths], found.where("false").select(
        "node", F.lit(0).cast("bigint").alias("links"), F.col("node").alias("root")))
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    told = stored(found.join(counted, "node", "left").join(joined, "node", "left").select(
        "h", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "node").alias("component")), "embed-told")
    hashed = vectors.select("vec_id", F.when(_valid(), _hashes()).alias("h"))
    return join_counted(hashed, told, "h", "copies", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"))
