"""Mix sources to target weights with a low-discrepancy schedule of equal-token blocks.

The documents of a source, shuffled by a hash, form a line of words that is cut into blocks of
``block_words``. Slots 0, 1, 2, ... of the mix are golden-ratio points in [0, 1); each falls into
the interval of one source, whose width is the source's share. The k-th slot of a source takes its
block k, starting over after the last block. A source's number of slots is set by its target: later
slots are left out, and the few that the points have not reached by the last slot come at the end,
so a source gives its target to the word while any stretch of the schedule stays near the shares.

Cases: a null text has size 0 and a size of 0 takes nothing; null sources are one source, last in
order; null ids and repeated rows are rows of their own; an empty table gives an empty mix. Only
the named columns are read, others do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.text import WORD
from talkgrain.plans.scratch import stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
#: A source's documents are laid out in so many hash ranges, so that no window holds a whole source.
RANGES = 1024
#: Cells of [0, 1) by which points meet source intervals in an equi-join.
CELLS = 4096
#: Slots of one source are ranked within runs of so many slots of the schedule.
RUN = 1 << 16
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(doc_id: Column) -> Column:
    """60 bits that shuffle the documents of a source."""
    key = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: size, weight, target share of all words, and ``want``, the target in
    whole words. Targets stop at ``max_repeats`` sizes; the excess goes to the others by weight.

    With the sources ordered by cap over weight, those that stop are a prefix, and all others get
    the same number of words per unit of weight: one pass over one row per source.
    """
    every = Window.orderBy("rank")
    level = Window.orderBy("cap_by_weight", "rank")
    whole = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scale = 1
    for w in weights:
        scale *= w
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        weight = F.when((F.col("rank") - 1) % len(weights) == k, w).otherwise(weight)
    ranked = ranked.select(
        "source", "source_size", "rank", weight.cast("bigint").alias("weight"),
        (F.col("source_size") * max_repeats).alias("cap"),
    ).withColumn("cap_by_weight", F.expr(f"cap * ({scale} div weight)"))
    filled = ranked.select(
        "*",
        F.sum("source_size").over(whole).alias("words"),
        (F.sum("cap").over(level) - F.col("cap")).alias("capped_before"),
        F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    ).withColumn("stops", F.expr("cap * weight_left <= weight * (words - capped_before)"))
    share = F.when(~F.col("stops"), F.struct(
        (F.col("words") - F.col("capped_before")).alias("left"), F.col("weight_left").alias("by")))
    filled = filled.withColumn("share", F.first(share, ignorenulls=True).over(whole))
    return filled.select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("stops"), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("share.left")).cast("double") / F.col("share.by"))
        .alias("target"),
        F.when(F.col("stops"), F.col("cap")).otherwise(
            F.expr("(2 * weight * share.left + share.by) div (2 * share.by)")).alias("want"),
    ).withColumn("start", F.sum("want").over(every) - F.col("want"))


def slot_counts(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add the blocks of each source and the slots it needs; a source's last block may be short."""
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    slots = F.expr(f"(want div source_size) * blocks"
                   f" + ((want % source_size) + {block_words - 1}) div {block_words}")
    return targets.withColumn("blocks", blocks).withColumn(
        "slots", F.when(F.col("source_size") > 0, slots).otherwise(0))


def schedule(counted: DataFrame, slots: int) -> DataFrame:
    """(slot, source, k): the source of every slot and the slot's rank k within its source."""
    spark = counted.sparkSession
    points = spark.range(slots).select(
        F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) % 1).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    total = F.sum("want").over(Window.partitionBy())
    intervals = counted.where("want > 0").select(
        "source", "rank", "slots",
        (F.col("start") / total).alias("low"), ((F.col("start") + F.col("want")) / total).alias("high"),
    ).withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    hits = points.join(intervals, "cell").where("low <= point and point < high").select(
        "rank", "slot", F.expr(f"slot div {RUN}").alias("run"))
    runs = hits.groupBy("rank", "run").agg(F.count("*").alias("n"))
    runs = runs.withColumn("before", F.sum("n").over(
        Window.partitionBy("rank").orderBy("run")) - F.col("n"))
    drawn = hits.join(runs.select("rank", "run", "before"), ["rank", "run"]).select(
        "rank", "slot", (F.col("before") - 1 + F.row_number().over(
            Window.partitionBy("rank", "run").orderBy("slot"))).alias("k"))
    drawn = drawn.join(counted.select("rank", "slots"), "rank").where("k < slots")
    reached = runs.groupBy("rank").agg(F.sum("n").alias("reached"))
    late = counted.select("rank", "slots").join(reached, "rank", "left").withColumn(
        "reached", F.coalesce("reached", F.lit(0))).where("reached < slots").select(
        "rank", F.explode(F.sequence("reached", F.col("slots") - 1)).alias("k"))
    return drawn.select("slot", "rank", "k").unionByName(
        late.select(F.lit(slots).cast("bigint").alias("slot"), "rank", "k"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: doc_id, h (hash of the text), source, size, source_size, target (of
    the source) and taken, the words that the mix takes from it, repeats counted."""
    sizes = stored(docs.select(
        "doc_id", "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size")).select(
        F.monotonically_increasing_id().alias("row"), "*", place(F.col("doc_id")).alias("place")),
        "mix-sizes")
    counted = stored(slot_counts(source_targets(sizes, weights, max_repeats), block_words),
                     "mix-sources")
    slots = counted.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    ranged = sizes.where("size > 0").join(
        counted.select("source", "rank"), sizes["source"].eqNullSafe(counted["source"])).select(
        "row", "doc_id", "rank", "size", "place", F.expr(f"place div {(1 << 60) // RANGES}").alias("range"))
    bases = ranged.groupBy("rank", "range").agg(F.sum("size").alias("words")).select(
        "rank", "range", (F.sum("words").over(Window.partitionBy("rank").orderBy("range"))
                          - F.col("words")).alias("base"))
    line = ranged.withColumn("upto", F.sum("size").over(
        Window.partitionBy("rank", "range").orderBy("place", "doc_id", "size", "row")
        .rowsBetween(Window.unboundedPreceding, 0)))
    line = line.join(bases, ["rank", "range"]).select(
        "row", "rank", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("a"))
    pieces = line.select("row", "rank", "a", (F.col("a") + F.col("size")).alias("b"), F.explode(
        F.expr(f"sequence(a div {block_words}, (a + size - 1) div {block_words})")).alias("block"))

    last = F.col("k") == F.col("slots") - 1
    rest = F.expr(f"if(want % source_size = 0, {block_words},"
                  f" (want % source_size) - block * {block_words})")
    uses = schedule(counted, slots).join(
        counted.select("rank", "source_size", "want", "blocks", "slots"), "rank").withColumn(
        "block", F.expr("k % blocks")).groupBy("rank", "block").agg(
        F.count(F.when(~last, 1)).alias("times"), F.max(F.when(last, rest)).alias("rest"))
    start = F.greatest(F.col("a"), F.col("block") * block_words)
    end = F.least(F.col("b"), (F.col("block") + 1) * block_words)
    part = F.least(end, F.col("block") * block_words + F.coalesce("rest", F.lit(0)))
    taken = pieces.join(uses, ["rank", "block"]).groupBy("row").agg(
        F.sum(F.col("times") * (end - start) + F.greatest(part - start, F.lit(0))).alias("taken"))
    told = sizes.join(counted.select(F.col("source").alias("of"), "source_size", "target"),
                      sizes["source"].eqNullSafe(F.col("of")))
    return told.join(taken, "row", "left").select(
        "doc_id", "h", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes words from: all their columns, then size, source_size, target
    and taken (columns of these names in ``docs`` give way). Rows that agree in id and text, if any,
    all carry the largest of their takes."""
    told = ["size", "source_size", "target", "taken"]
    taken = mix_sources(docs, **options).where("taken > 0").groupBy(
        F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(*(F.max(c).alias(f"_{c}") for c in told))
    same = docs["doc_id"].eqNullSafe(taken["_id"]) & (F.xxhash64(docs["text"]) == taken["_h"])
    columns = [docs[c] for c in docs.columns if c not in told]
    return docs.join(taken, same).select(*columns, *(taken[f"_{c}"].alias(c) for c in told))
