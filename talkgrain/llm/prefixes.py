"""The trie of conversation prefixes, by fixed-length block hashing.

Conversations are cut into blocks of ``BLOCK`` turns. The digest of a prefix of whole blocks is the exclusive
or of its blocks' hashes, each taken with the block's number, so all prefixes come from one running total
and no round walks down the turns. Conversations are grouped by the digests of their successive blocks first.
Where all that go on after a prefix go on with the same block, its turns are a chain of nodes with the same
members, read off one copy of the block; only where the next blocks of siblings differ are the rows of the
block opened turn by turn, and grouped by the digests of the turns.

What a subtree holds in all is summed without walking up: every node belongs to its smallest member, whose
path runs through all its ancestors. Each conversation sums what it owns from its end to every block, and
those sums are grouped like the conversations themselves.

One conversation, first turn or group of copies may hold a large share of all rows. Turns are ranked by
ranges, running totals go by pieces of ``PIECE`` blocks with one carry row each, groups are counted and
summed in the tasks before they meet, and a key that many rows look up is broadcast if it has more than one
in ``HOT_SHARE`` of them, which at most ``HOT_SHARE`` keys can have. The ids of the conversations that end at
a node are joined into long texts piece by piece and hashed as they stream by in order.

Digests have two 64-bit lanes. Texts are hashed in the scan and not shuffled.

Cases: rows without conv_id belong to no conversation and are left out; a null turn comes first, and turns of
one number follow each other by a hash of role and text; null role or text is empty, equal rows are turns of
their own; a conversation that loses all its turns when rebuilt ends at the root; an empty table gives no
nodes; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.ordering import ranked
from talkgrain.llm.text import in_small_batches
from talkgrain.plans.scratch import stored

#: Turns of a block.
BLOCK = 4
#: Blocks of one conversation that one task takes together.
PIECE = 1024
HOT_SHARE = 1000
#: Conversation ids joined into one text.
CHUNK = 50_000


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows.join(facts, keys)`` where the stored ``facts`` says how many of the rows have each key. A key
    with more than one in ``HOT_SHARE`` of all rows joins by broadcast, so its rows stay where they are."""
    total = facts.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * HOT_SHARE > F.lit(total)
    hot, rest = facts.where(often), facts.where(~often)
    cool = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cool.join(rest, keys))


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, bytes): each turn as two hashes of its role and text, and the text's bytes."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    return rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("a"),
                       F.xxhash64(F.lit("second"), "role", "text").alias("b"),
                       F.octet_length("text").cast("bigint").alias("bytes"))


def borrowed(conv_id: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """The turns (c, at, length, a, b, bytes) of every conversation c that begins with turns of the
    conversation ``c - c % family``, and (c, length) of all of them."""
    placed = stored(ranked(turns, "conv_id", ["turn", "a", "b"], "prefix-order").withColumn(
        "piece", F.expr(f"pos div {PIECE * BLOCK}")), "prefix-turns")
    sizes = placed.groupBy("conv_id").agg(F.max("size").alias("size"))
    first = F.expr(f"conv_id - conv_id % {family}")
    members = sizes.withColumn("first", first).withColumn("h", borrowed(F.col("conv_id")))
    lead = F.coalesce(F.max(F.when(F.col("conv_id") == F.col("first"), F.col("size"))), F.lit(0))
    families = members.groupBy("first").agg(
        lead.alias("lead"), F.collect_list(F.struct("conv_id", "size", "h")).alias("members"))
    families = stored(families.select("first", F.transform("members", lambda m: F.struct(
        m["conv_id"].alias("c"), m["size"].alias("size"), m["h"].alias("h"),
        F.least(m["h"], F.col("lead")).alias("taken"),
        (F.least(m["h"], F.col("lead")) + F.greatest(m["size"] - m["h"], F.lit(0))).alias("length"))).alias("members")),
        "prefix-families")
    each = families.select("first", F.explode("members").alias("m"), "members")
    in_use = each.select(F.col("m.c").alias("conv_id"), "first", "members", F.explode(F.expr(
        f"sequence(0L, (m.size - 1) div {PIECE * BLOCK})")).alias("piece"))
    use = F.transform("members", lambda m: F.when(
        (F.col("conv_id") == F.col("first")) & (F.col("pos") < m["h"]),
        F.struct(m["c"].alias("c"), m["length"].alias("length"), F.col("pos").alias("at"))).when(
        (F.col("conv_id") == m["c"]) & (F.col("pos") >= m["h"]),
        F.struct(m["c"].alias("c"), m["length"].alias("length"), (m["taken"] + F.col("pos") - m["h"]).alias("at"))))
    told = placed.join(in_use, ["conv_id", "piece"]).select(F.explode(F.array_compact(use)).alias("u"), "a", "b", "bytes")
    return (told.select("u.c", "u.length", "u.at", "a", "b", "bytes"),
            each.select("m.c", "m.length"))


def _lanes(j: Column, turns: Column) -> list[Column]:
    a, b = F.transform(turns, lambda t: t["a"]), F.transform(turns, lambda t: t["b"])
    return [F.xxhash64(j, a, b), F.xxhash64(F.lit("second"), j, a, b)]


def blocks(rows: DataFrame) -> DataFrame:
    """One row per conversation and block: c, piece, j, length, turns, the digest (pa, pb) of the blocks
    before it and (qa, qb) of those up to it."""
    dealt = rows.withColumn("j", F.expr(f"at div {BLOCK}")).withColumn("piece", F.expr(f"j div {PIECE}"))
    dealt = dealt.repartition("c", "piece").groupBy("c", "piece", "j").agg(
        F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("at", "a", "b", "bytes"))).alias("turns"))
    va, vb = _lanes(F.col("j"), F.col("turns"))
    dealt = dealt.withColumns({"va": va, "vb": vb})
    before = Window.partitionBy("c", "piece").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = dealt.groupBy("c", "piece").agg(F.bit_xor("va").alias("xa"), F.bit_xor("vb").alias("xb"))
    carry = carry.select("c", "piece", *(
        F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("xa", "xb")))
    inside = dealt.withColumns({
        p: F.coalesce(F.bit_xor(v).over(before), F.lit(0)) for p, v in (("pa", "va"), ("pb", "vb"))})
    met = inside.join(carry, ["c", "piece"]).withColumns({
        "pa": F.col("pa").bitwiseXOR(F.col("xa")), "pb": F.col("pb").bitwiseXOR(F.col("xb"))})
    return met.select("c", "piece", "j", "length", "turns", "pa", "pb", F.col("pa").bitwiseXOR(F.col("va")).alias("qa"),
                      F.col("pb").bitwiseXOR(F.col("vb")).alias("qb"))


def steps() -> Column:
    """The nodes of a block, turn by turn: number in the block, digest, digest before, bytes."""
    def digests(i: Column) -> list[Column]:
        lanes = _lanes(F.col("j"), F.slice("turns", F.lit(1), i))
        return [F.when(i == 0, F.col(p)).otherwise(F.col(p).bitwiseXOR(v)) for p, v in zip(("pa", "pb"), lanes, strict=True)]

    def step(i: Column) -> Column:
        (a, b), (fa, fb) = digests(i), digests(i - 1)
        return F.struct(i.alias("i"), a.alias("a"), b.alias("b"), fa.alias("fa"), fb.alias("fb"),
                        F.get("turns", i - 1)["bytes"].alias("bytes"))

    return F.transform(F.sequence(F.lit(1), F.size("turns")), step)


def _flagged(rows: DataFrame) -> DataFrame:
    """``blocks`` rows with ``fork``: whether different blocks follow the prefix before them."""
    ways = rows.groupBy("pa", "pb", "qa", "qb").agg(F.count("*").alias("n")).groupBy("pa", "pb").agg(
        (F.count("*") > 1).alias("fork"), F.sum("n").alias("n"))
    return split_join(rows, stored(ways, "prefix-ways"), ["pa", "pb"], "n").drop("n")


def _nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(a, b, fa, fb, depth, n, c, bytes): every node with its parent's digest and smallest member."""
    chains = rows.where("not fork").groupBy("qa", "qb").agg(
        F.count("*").alias("n"), F.min("c").alias("c"), *(F.first(x).alias(x) for x in ("j", "pa", "pb", "turns")))
    chains = chains.select("n", "c", "j", F.explode(steps()).alias("s"))
    depth = F.expr(f"j * {BLOCK} + s.i")
    chains = chains.select("s.a", "s.b", "s.fa", "s.fb", depth.alias("depth"), "n", "c", "s.bytes")
    opened = rows.where("fork").select("c", "j", F.explode(steps()).alias("s")).groupBy("s.a", "s.b").agg(
        F.first("s.fa").alias("fa"), F.first("s.fb").alias("fb"), F.first(depth).alias("depth"),
        F.count("*").alias("n"), F.min("c").alias("c"), F.first("s.bytes").alias("bytes"))
    none = F.lit(None).cast("bigint")
    root = lengths.agg(F.count("*").alias("n"), F.min("c").alias("c")).where("n > 0").select(
        F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), none.alias("fa"), none.alias("fb"),
        F.lit(0).cast("bigint").alias("depth"), "n", "c", F.lit(0).cast("bigint").alias("bytes"))
    return chains.unionByName(opened).unionByName(root)


def _sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, n_leaves, saved_tokens) of every node but the root, over its subtree."""
    told = ("saved", "leaf")
    owned = nodes.where("depth > 0").select(
        "c", F.expr(f"(depth - 1) div {BLOCK}").alias("j"), F.expr(f"(depth - 1) % {BLOCK} + 1").cast("int").alias("i"),
        F.expr("(n - 1) * bytes").alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    owned = owned.groupBy("c", F.expr(f"j div {PIECE}").alias("piece"), "j").agg(
        F.collect_list(F.struct("i", *told)).alias("own"), *(F.sum(x).alias(x) for x in told))
    met = rows.join(owned, ["c", "piece", "j"], "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in told})
    after = Window.partitionBy("c", "piece").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("c").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    carry = met.groupBy("c", "piece").agg(*(F.sum(x).alias(f"all_{x}") for x in told)).select("c", "piece", *(
        F.coalesce(F.sum(f"all_{x}").over(later), F.lit(0)).alias(f"later_{x}") for x in told))
    met = met.withColumns({f"after_{x}": F.coalesce(F.sum(x).over(after), F.lit(0)) for x in told}).join(
        carry, ["c", "piece"]).withColumns({f"after_{x}": F.col(f"after_{x}") + F.col(f"later_{x}") for x in told})

    def upto_end(x: str) -> Column:
        rest = F.filter(F.coalesce("own", F.array().cast("array<struct<i:int,saved:bigint,leaf:bigint>>")),
                        lambda o: o["i"] >= F.col("s.i"))
        return F.col(f"after_{x}") + F.aggregate(rest, F.lit(0).cast("bigint"), lambda held, o: held + o[x])

    sums = [F.sum(upto_end("leaf")).alias("n_leaves"), F.sum(upto_end("saved")).alias("saved_tokens")]
    given = ["j", "pa", "pb", "turns", "own", *(f"after_{x}" for x in told)]
    # Of the members of a chain only the smallest owns nodes in the block.
    chains = met.where("not fork").groupBy("qa", "qb").agg(
        *(F.first(x).alias(x) for x in ("j", "pa", "pb", "turns")), F.first("own", ignorenulls=True).alias("own"),
        *(F.sum(f"after_{x}").alias(f"after_{x}") for x in told)).select(*given)
    every = chains.unionByName(met.where("fork").select(*given)).select(
        "own", *(f"after_{x}" for x in told), F.explode(steps()).alias("s"))
    return every.groupBy("s.a", "s.b").agg(*sums)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, c) in order, the ids of one node joined: (a, b, first, ids)."""
    def out(key, first, ids):
        return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "first": [first], "ids": [",".join(ids)]})

    key, ids = None, []
    for rows in batches:
        for a, b, c in zip(*(rows.column(x).to_pylist() for x in ("a", "b", "c")), strict=True):
            if key is not None and (key != (a, b) or len(ids) >= CHUNK):
                yield out(key, int(ids[0]), ids)
                ids = []
            key = a, b
            ids.append(str(c))
    if ids:
        yield out(key, int(ids[0]), ids)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, hashed node by node: (a, b, ends_sha256)."""
    key, state = None, None
    done: dict[str, list] = {"a": [], "b": [], "ends_sha256": []}

    def close():
        for x, v in zip(done, (*key, state.hexdigest()), strict=True):
            done[x].append(v)

    for rows in batches:
        for a, b, ids in zip(*(rows.column(x).to_pylist() for x in ("a", "b", "ids")), strict=True):
            if key != (a, b):
                if key is not None:
                    close()
                key, state = (a, b), sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict(done, schema=_ENDS)
        done = {"a": [], "b": [], "ends_sha256": []}
    if key is not None:
        close()
        yield pa.RecordBatch.from_pydict(done, schema=_ENDS)


_ENDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])


def _ends(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes at which conversations end."""
    last = rows.where(F.expr(f"j * {BLOCK} + size(turns) = length")).select(
        F.col("qa").alias("a"), F.col("qb").alias("b"), "c")
    empty = lengths.where("length = 0").select(
        F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "c")
    line = in_small_batches(last.unionByName(empty)).repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c")
    chunks = line.mapInArrow(_chunks, "a bigint, b bigint, first bigint, ids string")
    met = chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return met.mapInArrow(_digests, "a bigint, b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie of the conversations whose turns are (c, at, length, a, b, bytes), ``at``
    from 0 on, and whose (c, length) are all listed: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    lengths = stored(lengths, "prefix-lengths")
    rows = stored(_flagged(stored(blocks(turns), "prefix-blocks")), "prefix-flagged")
    nodes = stored(_nodes(rows, lengths), "prefix-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("fa").alias("a"), F.col("fb").alias("b")).agg(
        F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["a", "b"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "prefix-nodes")
    parents = nodes.where("n_children > 0").select(
        F.col("a").alias("fa"), F.col("b").alias("fb"), F.col("c").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    told = split_join(nodes.where("depth > 0"), parents, ["fa", "fb"], "_n").drop("_n").join(
        _sums(rows, nodes), ["a", "b"])
    leaves, saved = nodes.agg(F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)),
                              F.sum(F.expr("(n - 1) * bytes"))).first()
    root = nodes.where("depth = 0").select("*", F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(
        leaves or 0).cast("bigint").alias("n_leaves"), F.lit(saved or 0).cast("bigint").alias("saved_tokens"))
    told = told.unionByName(root.select(*told.columns)).join(_ends(rows, lengths), ["a", "b"], "left")
    return told.select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, each beginning with turns of its family's first one."""
    return prefix_trie(*rebuilt(hashed_turns(conversations)))
