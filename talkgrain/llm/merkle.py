"""A Merkle manifest of a dataset, with a proof for every row, built by butterfly exchange.

A leaf is the digest of a document's fields; every source is a tree of fanout 3 over its leaves in order
of doc_id, and the sources' roots are the leaves of one tree above them.

The leaves of a source are cut into partitions of ``BLOCK`` consecutive ones, a power of the fanout, so
every partition is the whole subtree of one node (the last: of one ragged node). After each has folded its
own leaves, partitions exchange roots in rounds. In round r, the three partitions whose numbers differ
only in the r-th digit to base 3 meet and swap the roots of their subtrees of ``3**r`` partitions; each
hashes the parent itself and notes what stood left and right of its own. After the last round every
partition holds its source's root and the upper part of all its proofs, without a pass back down. Numbers
beyond a ragged end take part as empty carriers, fewer than twice as many as there are partitions, so that
every partition has all partners. No task holds more than one partition's leaves or three partners' rows,
whatever the size of a source. The tree over the sources is built in the same way, its leaves being their
roots, and what it adds to a proof joins the partitions of a source in runs of ``RUN``.

Digests are lowercase hex texts and are hashed as such. The field text is hashed in the scan: only
digests are shuffled.

Cases: a null field counts as ``-``, so null and empty texts differ; null ids come first in their source
and rows of one id follow by their leaves, of which equal ones are interchangeable; a null id is never
tampered with; the null source is a source of its own, first in order; repeated rows are leaves of their
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.ordering import ranked
from talkgrain.llm.text import in_small_batches
from talkgrain.plans.scratch import stored

FANOUT = 3
#: Leaves of a partition, a power of the fanout.
BLOCK = FANOUT ** 6
#: Partitions of one source that what the tree above adds is repeated for.
RUN = 256

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(**replaced: Column) -> Column:
    """The leaf digest of a document row."""
    return F.sha2(F.concat(*(field(replaced.get(c, F.col(c))) for c in FIELDS)), 256)


def fold(nodes: list[str]) -> list[str]:
    """The parents of a level."""
    return [digest(nodes[k:k + FANOUT]) for k in range(0, len(nodes), FANOUT)]


def levels(size: int, block: int) -> int:
    """Levels inside a partition: up to the root of a tree that it holds whole, else up to its own node."""
    size, n = min(size, block), 0
    while size > 1:
        size, n = -(-size // FANOUT), n + 1
    return n


def _towers(rows: pa.RecordBatch, block: int) -> Iterator[tuple[int, list[list[str]]]]:
    """The levels of each partition, from its leaves up to its one root."""
    sizes = rows.column("size").to_pylist()
    for k, leaves in enumerate(rows.column("leaves").to_pylist()):
        tower = [[x["leaf"] for x in leaves]]
        for _ in range(levels(sizes[k], block)):
            tower.append(fold(tower[-1]))
        yield k, tower


def _roots(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            roots = [tower[-1][0] for _, tower in _towers(rows, block)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("tree"), rows.column("block"), rows.column("size"), pa.array(roots, pa.string())],
                names=["tree", "block", "size", "node"])

    return run


def exchanged(roots: DataFrame, block: int) -> DataFrame:
    """(tree, block, root, path) from the partitions' roots (tree, block, size, node): the tree's root, and
    for each level above the partition what stands left and right of its ancestors there."""
    empty = F.array().cast("array<struct<left:string,right:string>>")
    most = roots.agg(F.max("size")).first()[0] or 0
    rounds = 0
    while block * FANOUT ** rounds < most:
        rounds += 1
    # A tree of one partition has no round, and a larger one as many as its partitions need.
    last = F.expr(f"(size + {block - 1}) div {block}")
    own = F.lit(0)
    for r in range(rounds):
        own = F.when(last > FANOUT ** r, r + 1).otherwise(own)
    now = roots.withColumn("rounds", own)
    # Numbers beyond the end carry nothing of their own.
    ends = now.where("rounds > 0").where(F.col("block") == last - 1)
    carriers = ends.select("tree", F.explode(F.sequence(
        F.col("block") + 1, F.pow(F.lit(FANOUT), F.col("rounds")).cast("bigint"))).alias("block"), "size",
        F.lit(None).cast("string").alias("node"), "rounds").where(
        F.col("block") < F.pow(F.lit(FANOUT), F.col("rounds")))
    now = now.unionByName(carriers).withColumn("path", empty)
    done = now.where("rounds = 0")
    for r in range(rounds):
        step = FANOUT ** r
        digit = F.expr(f"block div {step} % {FANOUT}")
        base = F.col("block") - digit * step
        given = F.array_sort(F.collect_list(F.struct(digit.alias("digit"), "block", "node", "path", "size", "rounds")))
        met = now.where(F.col("rounds") > r).groupBy("tree", base.alias("base")).agg(given.alias("given"))
        nodes = F.transform("given", lambda g: F.coalesce(g["node"], F.lit("")))
        text = F.array_join(nodes, "")
        met = met.select("tree", "given", nodes.alias("nodes"), F.when(text != "", F.sha2(text, 256)).alias("parent"))
        each = met.select("tree", "nodes", "parent", F.explode("given").alias("g"))
        beside = F.struct(
            F.array_join(F.slice("nodes", F.lit(1), F.col("g.digit").cast("int")), "").alias("left"),
            F.array_join(F.slice("nodes", F.col("g.digit").cast("int") + 2, F.lit(FANOUT)), "").alias("right"))
        now = stored(each.select(
            "tree", F.col("g.block").alias("block"), F.col("g.size").alias("size"), F.col("parent").alias("node"),
            F.col("g.rounds").alias("rounds"), F.concat("g.path", F.array(beside)).alias("path")),
            f"merkle-round-{r}")
        done = done.unionByName(now.where(F.col("rounds") == r + 1))
    home = done.where(F.col("block") < F.expr(f"(size + {block - 1}) div {block}"))
    return home.select("tree", "block", "size", F.col("node").alias("root"), "path")


PROOFS = "doc_id bigint, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def beside(tower: list[list[str]], at: int) -> list[dict[str, str]]:
    """What stands left and right of a leaf and its ancestors, level by level inside its partition."""
    out = []
    for nodes in tower[:-1]:
        first = at - at % FANOUT
        out.append({"left": "".join(nodes[first:at]), "right": "".join(nodes[at + 1:first + FANOUT])})
        at //= FANOUT
    return out


def climb(start: str, path: list[dict[str, str]]) -> str:
    """The root to which a leaf and its proof fold."""
    for step in path:
        start = digest([step["left"], start, step["right"]])
    return start


def _named_paths(block: int):
    """(name, root, path) of every leaf, whose name is in ``note``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for rows in batches:
            leaves, roots, above = (rows.column(c).to_pylist() for c in ("leaves", "root", "path"))
            found = [(x["note"], roots[k], beside(tower, at) + above[k])
                     for k, tower in _towers(rows, block) for at, x in enumerate(leaves[k])]
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), t) for v, t in zip(columns, (pa.string(), pa.string(), steps), strict=True)],
                names=["name", "root", "path"])

    return run


def _proofs(block: int):
    """The row of every document, whose altered leaf, if any, is in ``note``."""
    names = [c.split()[0] for c in PROOFS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            leaves, trees, subroots, roots, above, top = (rows.column(c).to_pylist() for c in (
                "leaves", "tree", "subroot", "root", "path", "top"))
            found = []
            for k, tower in _towers(rows, block):
                source = trees[k][1:] if trees[k] else None
                for at, x in enumerate(leaves[k]):
                    path = beside(tower, at) + above[k] + top[k]
                    found.append((x["doc_id"], source, x["leaf"], subroots[k], roots[k],
                                  digest([s[side] for s in path for side in ("left", "right")]),
                                  climb(x["note"] or x["leaf"], path)))
            columns = zip(*found, strict=True) if found else ((),) * len(names)
            kinds = [pa.int64()] + [pa.string()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], names=names)

    return run


def forest(leaves: DataFrame, block: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The partitions (tree, block, size, leaves) of all trees, and what :func:`exchanged` tells each, from
    rows (tree, doc_id, leaf, note)."""
    placed = ranked(leaves, "tree", ["doc_id", "leaf"], f"{name}-order")
    given = F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", "note")))
    blocks = in_small_batches(stored(placed.groupBy("tree", F.expr(f"pos div {block}").alias("block")).agg(
        F.max("size").alias("size"), given.alias("leaves")), f"{name}-blocks"))
    roots = blocks.mapInArrow(_roots(block), "tree string, block bigint, size bigint, node string")
    return blocks, stored(exchanged(stored(roots, f"{name}-roots"), block), f"{name}-paths")


def manifest(docs: DataFrame, altered: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot (its source's root), root, proof_sha256, folded_root (from the
    row's leaf, or the one with the ``altered`` text where that is not null, up its proof) and verified
    (folded_root equals root)."""
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    rows = docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in FIELDS),
                       (F.lit(None) if altered is None else altered).cast("string").alias("_altered"))
    # Trees sort like their sources, the null source first.
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    blocks, paths = forest(rows.select(
        tree.alias("tree"), "doc_id", leaf().alias("leaf"),
        F.when(F.col("_altered").isNotNull(), leaf(text=F.col("_altered"))).alias("note")), block, "merkle")
    sources = paths.where("block = 0").select(F.lit("").alias("all"), "tree", "root")
    tops, upper = forest(ranked(sources, "all", ["tree"], "merkle-sources").select(
        F.lit("").alias("tree"), F.col("pos").alias("doc_id"), F.col("root").alias("leaf"),
        F.col("tree").alias("note")), block, "merkle-top")
    above = tops.join(upper.drop("size"), ["tree", "block"]).mapInArrow(
        _named_paths(block), "name string, root string, path array<struct<left:string,right:string>>")
    ends = paths.where("block = 0").select("tree", F.explode(F.expr(
        f"sequence(0L, (size - 1) div {block} div {RUN})")).alias("run"))
    runs = ends.join(above, ends["tree"] == above["name"]).select("tree", "run", "root", F.col("path").alias("top"))
    told = paths.select("tree", "block", F.expr(f"block div {RUN}").alias("run"),
                        F.col("root").alias("subroot"), "path").join(runs, ["tree", "run"]).drop("run")
    return blocks.join(told, ["tree", "block"]).mapInArrow(_proofs(block), PROOFS).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
