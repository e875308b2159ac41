"""Benchmark decontamination by spaced-seed hashing, in built-in DataFrame functions only.

A seed looks at ``span`` consecutive tokens and hashes those a fixed mask selects, so a substituted
token breaks only the masks that select it. All seeds of the benchmark meet all seeds of all texts.
Hits of one document and item on one diagonal (equal distance of positions) are then verified: from
some hit to the same or a later one, at least ``percent`` of the tokens agree. All such stretches
count, so neither replaced words between two copied parts nor a chance hit far away hide an overlap;
the one with the most agreeing tokens is reported. A document with a verified overlap is contaminated.

An item of fewer than ``SPAN`` tokens holds no seed. It is found where all its tokens stand in a row, by
one 64-bit hash of them, joined with those of the texts' windows of the lengths that short items have.

The benchmark's seeds are broadcast when they are at most ``BROADCAST_ROWS``, else joined by a
shuffle; only hits go further, and only texts with hits are read again.

Cases: tokens are the words of the lower-cased text; a null or empty text or item has none and is never
matched; a text of fewer than ``SPAN`` tokens can hold only short items; a short item is found in every
text that says it, also one of a single word (``shortest`` leaves out items of fewer tokens); null ids and null item ids
match nothing; rows with one id are judged together, repeated rows stay rows; an empty benchmark
leaves every document clean; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.components import BROADCAST_ROWS, among
from talkgrain.plans.scratch import stored

#: Positions that each mask selects among ``SPAN`` tokens.
MASKS = ((0, 1, 2, 4, 6, 7, 10), (0, 1, 3, 5, 6, 9, 10), (0, 2, 3, 4, 7, 8, 10))
SPAN = 11
PERCENT = 70
#: Items of fewer tokens are not looked for.
SHORTEST = 1


def tokens(text: Column) -> Column:
    lower = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_remove(F.split(lower, "[\\x20\\x09-\\x0D]+"), "")


def seeds(rows: DataFrame, key: str) -> DataFrame:
    """(key, mask, seed, at): the hash of every mask at every position."""
    hashed = rows.select(key, F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    hashed = hashed.where(F.size("w") >= SPAN).withColumn("last", F.size("w") - SPAN)
    places = F.sequence(F.lit(0), F.col("last"))

    def masked(mask):
        return F.transform(places, lambda i: F.xxhash64(*(F.get("w", i + o) for o in mask)))

    each = hashed.select(key, "last", F.posexplode(F.concat(*map(masked, MASKS))).alias("p", "seed"))
    return each.select(key, F.expr("p div (last + 1)").cast("int").alias("mask"), "seed",
                       F.expr("p % (last + 1)").cast("int").alias("at"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift, places): the sorted item positions of the hits on a diagonal."""
    items = stored(seeds(benchmark.where("item_id is not null"), "item_id").withColumnRenamed("at", "j"),
                   "decontam-seeds")
    small = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = seeds(docs.where("doc_id is not null"), "doc_id")
    met = own.join(F.broadcast(items) if small else items, ["mask", "seed"])
    return met.groupBy("doc_id", "item_id", (F.col("at") - F.col("j")).alias("shift")).agg(
        F.sort_array(F.collect_set("j")).alias("places"))


def short_matches(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame | None:
    """(doc_id, item_id, matched) of the items of fewer than ``SPAN`` tokens; None if there are none."""
    items = benchmark.where("item_id is not null").select("item_id", tokens(F.col("text")).alias("t")).where(
        F.size("t").between(max(1, shortest), SPAN - 1)).select(
        "item_id", F.size("t").alias("matched"), F.transform("t", lambda w: F.xxhash64(w)).alias("w"))

    def window(first, length):
        return F.xxhash64(F.lit(length), *(F.get("w", first + o) for o in range(length)))

    items = stored(items.select("item_id", "matched", F.coalesce(*(
        F.when(F.col("matched") == n, window(F.lit(0), n)) for n in range(1, SPAN))).alias("seed")).distinct(),
        "decontam-short")
    lengths = [r["matched"] for r in items.select("matched").distinct().orderBy("matched").collect()]  # under SPAN
    if not lengths:
        return None
    small = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hashed = docs.where("doc_id is not null").select(
        "doc_id", F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))

    def windows(length):
        places = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
        # A window past the end of a short text holds null.
        return F.filter(F.transform(places, lambda i: F.when(i + length <= F.size("w"), window(i, length))),
                        lambda h: h.isNotNull())

    own = hashed.select("doc_id", F.explode(F.array_distinct(F.concat(*map(windows, lengths)))).alias("seed"))
    return own.join(F.broadcast(items) if small else items, "seed").select("doc_id", "item_id", "matched").distinct()


def agreeing(low: Column, end: Column) -> Column:
    """How many item tokens ``b`` from ``low`` to before ``end`` agree with ``d`` on the diagonal."""
    place = F.filter(F.sequence(low, end), lambda t: t < end)
    return F.size(F.filter(place, lambda t: F.get("b", t) == F.get("d", t + F.col("shift"))))


def most_agreeing(percent: int) -> Column:
    """The most agreeing tokens of a verified stretch between two hits of ``places``, or null."""
    places = F.col("places")
    low, high = F.get(places, F.lit(0)), F.element_at(places, -1)
    whole = agreeing(low, high + SPAN)
    # Of each hit: its place, the agreeing tokens from the first hit to before it, and to its end.
    walk = F.aggregate(
        places, F.expr("named_struct('place', places[0], 'before', 0,"
                       " 'all', cast(array() as array<struct<place:int, before:int, upto:int>>))"),
        lambda s, p: _step(s, p))["all"]

    def lack(agreed, place):
        return percent * (place - low) - 100 * agreed

    # A stretch from hit p to hit q holds if lack(end of q) <= lack(p): the first such p is the best.
    def best(hits):
        return F.array_max(F.transform(hits, lambda q: q["upto"] - F.get(F.filter(
            hits, lambda p: (p["place"] <= q["place"]) & (
                lack(q["upto"], q["place"] + SPAN) <= lack(p["before"], p["place"]))), F.lit(0))["before"]))

    walked = F.get(F.transform(F.array(walk), best), F.lit(0))
    return F.when(100 * whole >= percent * (high - low + SPAN), whole).otherwise(walked)


def _step(state: Column, place: Column) -> Column:
    before = (state["before"] + agreeing(state["place"], place)).cast("int")
    hit = F.struct(place.alias("place"), before.alias("before"),
                   (before + agreeing(place, place + SPAN)).cast("int").alias("upto"))
    return F.struct(place.alias("place"), before.alias("before"),
                    F.concat(state["all"], F.array(hit)).alias("all"))


def overlaps(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, matched): verified overlaps, the most agreeing tokens of each pair."""
    found = stored(hits(docs, benchmark), "decontam-hits")
    texts = among(docs, "doc_id", found, "doc_id").select("doc_id", tokens(F.col("text")).alias("d"))
    items = among(benchmark, "item_id", found, "item_id").select("item_id", tokens(F.col("text")).alias("b"))
    pairs = found.join(items, "item_id").join(texts, "doc_id")
    verified = pairs.select("doc_id", "item_id", most_agreeing(percent).cast("bigint").alias("matched")).where(
        "matched is not null")
    short = short_matches(docs, benchmark, shortest)
    if short is not None:
        verified = verified.unionByName(short.withColumn("matched", F.col("matched").cast("bigint")))
    return verified.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_items (items found in it), matched (most tokens of one overlap), first_item (-1:
    none) and contaminated, for every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    benchmark = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    found = overlaps(docs, benchmark, percent).groupBy(F.col("doc_id").alias("of")).agg(
        F.count("*").alias("n_items"), F.max("matched").alias("matched"), F.min("item_id").alias("first_item"))
    rows = docs.select("doc_id")
    return rows.join(found, rows["doc_id"] == found["of"], "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"),
        F.coalesce("first_item", F.lit(-1)).alias("first_item"),
        F.col("n_items").isNotNull().alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, same columns, without contaminated documents."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = stored(overlaps(slim, benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text"),
                            percent).select("doc_id").distinct(), "decontam-found")
    return among(docs, "doc_id", found, "doc_id", "left_anti")
