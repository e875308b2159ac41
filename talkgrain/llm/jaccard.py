"""Exact n-gram Jaccard join: a blocked sparse product of documents by n-grams.

Two documents link when ``100 * |x & y| >= percent * |x | y|``. The product is never formed whole:

1. *Sizes and signatures.* Documents with one and the same set are one node.
2. *Sparse blocks.* The order of hashes is a shuffled order of all n-grams. With a = ceil(percent/100
   * n), two linked documents share at least k n-grams within the first n - a + k of each. So a task
   sends only these, and a document stays only if enough of them occur in another document. N-grams
   that meet inside a task's slice are counted there and sent once.
3. *Dense block.* For the documents that stay, document frequencies over their whole sets are exact;
   a document needs ``a`` n-grams of frequency 2 or more. Ordered rarest first, linked documents
   share one of their first n - a + 1. These rows are the incidence block.
4. *Overlap counts.* First each document meets the smallest document of each of its rows: a star per
   n-gram instead of all its pairs. Accumulated counts discard pairs that cannot reach the overlap
   their sizes ask for; the rest are counted over whole sets. What these links connect is one
   component. Then the block is multiplied by itself across components only, tile by tile.

All pairs of different components that could link are counted, so components are exact; pairs inside
a component found already need no count. (N-grams are told apart by 64-bit hashes.)

Cases: a null, empty or white text has an empty set and links with nothing; with fewer words than
``width`` the whole sequence is the one n-gram; rows with one id are one node with the links of each of
its texts, a null id links with nothing; repeated rows stay rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.components import among, components, equal_rows, join_counted
from talkgrain.llm.text import LOWER, in_small_batches, mix, slices, windows, word_hashes, word_spans
from talkgrain.plans.scratch import stored

WIDTH = 5
PERCENT = 75
#: Further shared n-grams asked for in step 2: one per so many n-grams of the document.
SPARE = 12
#: N-grams of the documents that a task holds as one tile, and documents streamed past it.
TILE = 1 << 16
SENT = 2048


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its first row, the sorted distinct n-gram hashes of its rows one after
    another, and where each row's begin (one entry more)."""
    for first_row, end_row, data, offsets in slices(column):
        data = LOWER[data]
        start, end, first = word_spans(data, offsets)
        gram, row = windows(word_hashes(data, start, end), first, width)
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        gram, row = gram[new], row[new]
        yield first_row, gram, np.searchsorted(row, np.arange(end_row - first_row + 1))


def signatures(gram: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row's set."""
    out = []
    for values in (gram, mix(gram ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.zeros(len(gram) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def profiles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (size of the set) and the set's signature, of every row."""
    def run(batches):
        for batch in batches:
            for row, gram, first in shingle_sets(batch.column(1), width):
                a, b = signatures(gram, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(a)), pa.array(np.diff(first)), pa.array(a),
                     pa.array(b)], ["doc_id", "n", "sig_a", "sig_b"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n bigint, sig_a bigint, sig_b bigint")


def sparse_blocks(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of step 2: (doc_id, gram) for the first n-grams of a document; (null, gram) once for those
    that several rows of a slice have; (doc_id, null, weight) with the document's number of these
    less the number it needs."""
    def run(batches):
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            ids = batch.column(0)
            for at, gram, first in shingle_sets(batch.column(1), width):
                n = np.diff(first)
                a, b = signatures(gram, first)
                fresh = np.zeros(len(n), bool)
                for k, key in enumerate(zip(n.tolist(), a.tolist(), b.tolist(), strict=True)):
                    if n[k] and key not in seen:
                        seen.add(key)
                        fresh[k] = True
                least = least_overlap(n, percent)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(gram)) - first[row]
                use = fresh[row] & (place < (n - least + 1 + n // SPARE)[row])
                gram, row = gram[use], row[use]
                kinds, kind, times = np.unique(gram, return_inverse=True, return_counts=True)
                here = times[kind] > 1
                met = np.bincount(row[here], minlength=len(n)) - (1 + least // SPARE)
                some = np.flatnonzero(fresh)
                doc = ids.slice(at, len(n))
                common = kinds[times > 1].view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([doc.take(pa.array(row[~here])), doc.take(pa.array(some)),
                                      pa.nulls(len(common), pa.int64())]),
                    pa.concat_arrays([pa.array(gram[~here].view(np.int64)),
                                      pa.nulls(len(some), pa.int64()), pa.array(common)]),
                    pa.array(np.concatenate([np.zeros((~here).sum(), np.int32),
                                             met[some].astype(np.int32),
                                             np.zeros(len(common), np.int32)]))],
                    ["doc_id", "gram", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, gram bigint, weight int")


def gram_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, signature and the set itself, sorted as unsigned hashes, of every row."""
    def run(batches):
        for batch in batches:
            for row, gram, first in shingle_sets(batch.column(1), width):
                a, b = signatures(gram, first)
                grams = pa.ListArray.from_arrays(
                    pa.array(first.astype(np.int32)), pa.array(gram.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(a)), pa.array(np.diff(first)), pa.array(a),
                     pa.array(b), grams], ["doc_id", "n", "sig_a", "sig_b", "grams"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n bigint, sig_a bigint, sig_b bigint, grams array<bigint>")


def candidates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id of the documents that step 2 keeps."""
    rows = sparse_blocks(docs, width, percent)
    frequency = F.count("*").over(Window.partitionBy("gram"))
    met = rows.where("gram is not null").withColumn("df", frequency).where(
        "df > 1 and doc_id is not null").select("doc_id", F.lit(1).alias("weight"))
    return met.unionByName(rows.where("gram is null").select("doc_id", "weight")).groupBy(
        "doc_id").agg(F.sum("weight").alias("spare")).where(
        "spare >= 0 and doc_id is not null").select("doc_id")


def incidence(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (doc_id, n, gram, suffix) of step 3; ``suffix`` counts the n-grams after the prefix."""
    grams = sets.select("doc_id", F.explode("grams").alias("gram"))
    shared = stored(grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-shared")
    least = F.expr(f"({percent} * n + 99) div 100")
    kept = join_counted(grams, shared, "gram", "df").groupBy("doc_id").agg(
        F.collect_list(F.struct("df", "gram")).alias("common"))
    kept = kept.join(sets.select("doc_id", "n"), "doc_id").where(F.size("common") >= least)
    room = (F.size("common") - least + 1).cast("int")
    return kept.select("doc_id", "n", (least - 1).alias("suffix"), F.explode(F.slice(
        F.sort_array("common"), 1, room)).alias("c")).select("doc_id", "n", "suffix", "c.gram")


def overlapping(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both, pair, size = [], [], []
                for c in (2, 3):
                    lists = part.column(c)
                    n = np.diff(lists.offsets.to_numpy())
                    both.append(lists.flatten().to_numpy().view(np.uint64))
                    pair.append(np.repeat(np.arange(len(n), dtype=np.uint64), n))
                    size.append(n.astype(np.int64))
                pair = np.concatenate(pair)
                key = np.concatenate(both)
                order = np.lexsort((key, pair))
                key, pair = key[order], pair[order]
                same = (key[1:] == key[:-1]) & (pair[1:] == pair[:-1])
                shared = np.bincount(pair[1:][same].astype(np.int64), minlength=part.num_rows)
                link = 100 * shared >= percent * (size[0] + size[1] - shared)
                keep = pa.array(np.flatnonzero(link))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    pairs = stored(pairs.select("a", "b"), "jaccard-pairs")
    both = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    both = stored(both.distinct(), "jaccard-paired")
    left, right = (among(x, c, both, "doc_id") for x, c in ((left, "a"), (right, "b")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        run, "a bigint, b bigint")


def _fits(percent: int) -> str:
    """SQL: sizes na, nb allow a link; so do ``c`` n-grams shared in the prefixes."""
    return (f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
            f" and {100 + percent} * (c + greatest(sa, sb)) >= {percent} * (na + nb)")


def star_pairs(block: DataFrame, percent: int, pick) -> DataFrame:
    """Each document with the document ``pick`` of each of its n-grams."""
    star = stored(block.groupBy("gram").agg(
        pick(F.struct("doc_id", "n", "suffix")).alias("s"), F.count("*").alias("df")).where("df > 1"),
        "jaccard-stars")
    met = join_counted(block, star, "gram", "df").where("doc_id <> s.doc_id")
    return met.groupBy(F.least("doc_id", "s.doc_id").alias("a"), F.greatest("doc_id", "s.doc_id").alias("b")).agg(
        F.first("n").alias("na"), F.first("s.n").alias("nb"), F.first("suffix").alias("sa"),
        F.first("s.suffix").alias("sb"), F.count("*").alias("c")).where(_fits(percent)).select("a", "b")


def crossing_links(block: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between different components: the product of the block with itself, a tile at
    a time. Documents that meet in their n-grams are cut into tiles of about ``TILE`` n-grams; a
    document goes to the tiles that share an n-gram with it and hold a document of a larger component
    (or an equally large one with a larger id). A task holds one tile, the documents sent to it
    stream past, and only links leave it. A tile that is sent many documents is held by several tasks.
    """
    of = F.coalesce("component", "doc_id")
    labelled = block.join(labels, block["doc_id"] == labels["node"], "left").select(
        "doc_id", "n", "gram", of.alias("of"))
    mixed = labelled.groupBy("gram").agg(
        F.min("of").alias("low"), F.max("of").alias("high"), F.count("*").alias("df"),
        F.min("doc_id").alias("first")).where("low < high").select("gram", "df", "first")
    rows = stored(labelled.join(mixed, "gram"), "jaccard-mixed")
    docs = rows.groupBy("doc_id").agg(
        F.first("of").alias("of"), F.first("n").alias("n"),
        F.max_by("first", F.struct("df", "gram")).alias("cluster"))
    sizes = docs.groupBy("of").agg(F.count("*").alias("size"))
    tiles = docs.groupBy("cluster").agg(F.expr(f"sum(n) div {TILE} + 1").alias("tiles"))
    docs = stored(docs.join(sizes, "of").join(tiles, "cluster").select(
        "doc_id", F.struct("size", "of").alias("rank"), "cluster",
        F.pmod(F.xxhash64("doc_id"), "tiles").alias("tile")), "jaccard-tiles")
    placed = rows.select("gram", "doc_id").join(docs, "doc_id")
    held = placed.groupBy("gram", "cluster", "tile").agg(F.max("rank").alias("top"))
    sent = placed.select("gram", F.col("doc_id").alias("x"), F.col("rank").alias("own")).join(
        held, "gram").where("own < top").select("cluster", "tile", "x", "own").distinct()
    sent = stored(sent, "jaccard-sent")
    tasks = sent.groupBy("cluster", "tile").agg(F.expr(f"count(*) div {SENT} + 1").alias("tasks"))
    needed = among(sets, "doc_id", docs, "doc_id").select("doc_id", "grams")
    moving = sent.join(tasks, ["cluster", "tile"]).join(needed, F.col("x") == F.col("doc_id")).select(
        "cluster", "tile", F.pmod(F.xxhash64("x"), "tasks").alias("task"), F.lit(1).alias("moves"),
        "doc_id", F.col("own.size").alias("size"), F.col("own.of").alias("of"), "grams")
    standing = docs.join(tasks, ["cluster", "tile"]).join(needed, "doc_id").select(
        "cluster", "tile", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"),
        F.lit(0).alias("moves"), "doc_id", F.col("rank.size").alias("size"),
        F.col("rank.of").alias("of"), "grams")
    place = ["cluster", "tile", "task"]
    return moving.unionByName(standing).repartition(*place).sortWithinPartitions(
        *place, "moves").mapInArrow(_tile_product(percent), "a bigint, b bigint")


def _tile_product(percent: int):
    """Links between the documents of each tile and those that follow it in the sorted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, gram, row = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                part, place = batch.slice(a, b - a), tuple(keys[a, :3])
                if place != tile:
                    tile, parts, gram = place, [], None
                if not keys[a, 3]:
                    parts.append(part)
                    continue
                if not parts:  # no document stands in this tile
                    continue
                if gram is None:
                    ids, size, of, lists = (pa.concat_arrays([p.column(k) for p in parts]) for k in (4, 5, 6, 7))
                    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                    gram, row = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(n)), n)
                    order = np.argsort(gram, kind="stable")
                    gram, row = gram[order], row[order]
                    held = (ids.to_numpy(), size.to_numpy(), of.to_numpy(), n)
                for s in range(0, part.num_rows, 24):
                    yield _product(part.slice(s, 24), gram, row, held, percent)

    return run


def _product(moving: pa.RecordBatch, gram, row, held, percent: int) -> pa.RecordBatch:
    ids, size, of, lists = (moving.column(k) for k in (4, 5, 6, 7))
    own = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    value = lists.flatten().to_numpy().view(np.uint64)
    of_row = np.repeat(np.arange(len(own)), own)
    low, high = np.searchsorted(gram, value), np.searchsorted(gram, value, side="right")
    times = high - low
    at = np.arange(times.sum()) + np.repeat(low - (np.cumsum(times) - times), times)
    width = len(held[0])
    shared = np.bincount(np.repeat(of_row, times) * width + row[at], minlength=len(own) * width).reshape(-1, width)
    size, of = size.to_numpy()[:, None], of.to_numpy()[:, None]
    larger = (held[1] > size) | ((held[1] == size) & (held[2] > of))
    x, y = np.nonzero(larger & (100 * shared >= percent * (own[:, None] + held[3] - shared)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.to_numpy()[x]), pa.array(held[0][y])], ["a", "b"])


def told_apart(docs: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows that have an id, each text of an id under a number of its own, and (node, own): the ids
    of the numbers made for ids of several texts (None: no id has several)."""
    docs = docs.where("doc_id is not null")
    sets = F.struct("n", "sig_a", "sig_b")
    several = stored(profile.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(sets).alias("a"), F.max(sets).alias("b")).where("a <> b").select("doc_id"), "jaccard-several")
    if several.isEmpty():
        return docs, None
    texts = among(docs, "doc_id", several, "doc_id").distinct()
    ids = stored(profile.where("doc_id is not null").select("doc_id").distinct(), "jaccard-ids")
    for salt in itertools.count():
        made = stored(texts.select(F.xxhash64(F.lit(salt), "doc_id", F.sha2("text", 256)).alias("node"),
                                   F.col("doc_id").alias("own"), "text"), "jaccard-numbered")
        taken = made.join(ids, made["node"] == ids["doc_id"], "left_semi")
        if taken.isEmpty() and made.groupBy("node").count().where("count > 1").isEmpty():
            break
    single = among(docs, "doc_id", several, "doc_id", "left_anti")
    return single.unionByName(made.select(F.col("node").alias("doc_id"), "text")), made.select("node", "own")


def of_ids(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """The edges with the ids in place of the numbers that ``told_apart`` made."""
    for end in ("a", "b"):
        edges = edges.join(owners, edges[end] == owners["node"], "left").withColumn(
            end, F.coalesce("own", end)).select("a", "b")
    return edges


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    docs = in_small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = stored(profiles(docs, width), "jaccard-profiles")
    docs, owners = told_apart(docs, profile)
    kept = stored(candidates(docs, width, percent), "jaccard-candidates")
    sets = stored(gram_sets(among(docs, "doc_id", kept, "doc_id"), width), "jaccard-sets")
    same = ["n", "sig_a", "sig_b"]
    chosen = stored(sets.groupBy(*same).agg(F.min("doc_id").alias("doc_id")), "jaccard-chosen")
    sets = among(sets, "doc_id", chosen, "doc_id")
    block = stored(incidence(sets, percent), "jaccard-block")

    edges = stored(overlapping(star_pairs(block, percent, F.min), sets, percent), "jaccard-edges")
    labels = components(edges)
    more = stored(crossing_links(block, labels, sets, percent), "jaccard-edges")
    equal = equal_rows(profile.where("n > 0 and doc_id is not null"), same, "doc_id")
    links = edges.unionByName(more)
    found = components((of_ids(links, owners) if owners else links).unionByName(equal))
    return profile.join(found, profile["doc_id"] == found["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, same columns, without near duplicates: of each component the document with
    the smallest id stays, once if several rows have that id. Rows without an id stay."""
    found = stored(link_components(docs, width, percent), "jaccard-components")
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone")
    kept = among(docs, "doc_id", gone, "doc_id", "left_anti")
    often = stored(found.where("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "jaccard-often")
    if often.isEmpty():
        return kept
    return among(kept, "doc_id", often, "doc_id", "left_anti").unionByName(
        among(kept, "doc_id", often, "doc_id").dropDuplicates(["doc_id"]))
