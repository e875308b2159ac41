"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in DataFrame functions only.

A shingle is five consecutive words; its hash has 48 bits. The fingerprint of a text holds the ``K``
smallest different hashes of its shingles in ascending order, twelve hex digits each. It is a function
of the set of shingles alone, so equal texts have equal fingerprints, and the fingerprints of parts
merge into that of the whole (:func:`merged`, :func:`merged_by`). From two fingerprints follow an
estimate of the resemblance (Jaccard similarity of the shingle sets), of containment, and of the
number of distinct shingles; all are exact while a set has fewer than ``K`` shingles.

A long text is hashed run by run of ``RUN`` shingles, each run merged into the sketch so far, so the
hashes held at once are bounded.

:func:`edited_fingerprints` compares each document with an edited text, whose second half comes from
the next document. Texts move once, to their document's key; what moves on is the part of the next
text that is wanted, with that document's fingerprint.

Cases: A-Z count as a-z, words lie between the six ASCII white-space characters; a text with fewer than
five words but at least one is one shingle; a null text is empty, an empty or blank text has the empty
fingerprint; two empty fingerprints have resemblance 1, an empty and another one 0; null ids come first
in the order, texts of one id follow each other by a hash of the text; rows equal in id and text are
rows of their own, each one the next of the one before; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.ordering import bound, ranked
from talkgrain.plans.scratch import stored

#: Hashes in a fingerprint: an estimate of a resemblance J has the standard error sqrt(J (1 - J) / K).
K = 128
WIDTH = 5
#: Shingles hashed before they are merged into the sketch.
RUN = 1 << 13
DIGITS, SPACE_48 = 12, float(1 << 48)


def word_codes(text: Column) -> Column:
    """The CRC-32 of every word."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def _smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def _run_hashes(codes: Column, first: Column, end: Column) -> Column:
    # Beyond the last word get() is null, which the hash passes over: few words are one shingle.
    return F.transform(F.sequence(first, end - 1), lambda i: F.shiftrightunsigned(
        F.xxhash64(*(F.get(codes, i + k) for k in range(WIDTH))), 16))


def fingerprint(text: Column, k: int = K) -> Column:
    """The fingerprint of a text."""
    def of(codes: Column) -> Column:
        count = F.greatest(F.size(codes) - (WIDTH - 1), F.least(F.size(codes), F.lit(1)))
        runs = F.sequence(F.lit(0), F.floor((count - 1) / RUN).cast("int"))
        sketch = F.aggregate(runs, F.array().cast("array<bigint>"), lambda held, r: _smallest(F.concat(
            held, _run_hashes(codes, r * RUN, F.least((r + 1) * RUN, count))), k))
        return F.when(count > 0, _text_of(sketch)).otherwise(F.lit(""))

    return bound(word_codes(text), of)


def _text_of(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def hashes(print_: Column) -> Column:
    """The hashes of a fingerprint, as hex texts, which sort like the numbers."""
    return F.regexp_extract_all(print_, F.lit(f".{{{DIGITS}}}"), F.lit(0))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two texts' shingles together."""
    return F.array_join(_smallest(F.concat(hashes(a), hashes(b)), k), "")


def merged_by(rows: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """The merged fingerprint of each group: (keys, column). A group of any size is cut down to its
    ``k`` smallest hashes by every task before these meet."""
    each = rows.select(*keys, F.explode(hashes(F.col(column))).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    least = each.withColumn("_k", rank).where(F.col("_k") <= k).groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list("_h")), "").alias(column))
    empty = rows.select(*keys).distinct()
    same = [empty[c].eqNullSafe(least[c]) for c in keys]
    return empty.join(least, same, "left").select(
        *(empty[c] for c in keys), F.coalesce(least[column], F.lit("")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two shingle sets, 0 to 1."""
    def of(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        whole = (F.size(x) < k) & (F.size(y) < k)

        def share(union: Column) -> Column:
            both = F.array_intersect(F.array_intersect(x, y), union)
            return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
                F.size(both).cast("double") / F.greatest(F.size(union), F.lit(1)))

        union = F.array_union(x, y)
        return bound(F.when(whole, union).otherwise(F.slice(F.sort_array(union), 1, k)), share)

    return F.when(a == b, F.lit(1.0)).otherwise(
        bound(F.named_struct(F.lit("x"), hashes(a), F.lit("y"), hashes(b)), of))


def distinct_shingles(print_: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    count = F.floor(F.length(print_) / DIGITS)
    last = F.conv(F.right(print_, F.lit(DIGITS)), 16, 10).cast("double")
    return F.when(count < k, count.cast("double")).otherwise((k - 1) * SPACE_48 / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too, 0 to 1; null where a has none."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.length(a) > 0, F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and fingerprint of every row."""
    return docs.select("doc_id", fingerprint(F.col("text"), k).alias("fingerprint"))


def _key(doc_id: Column, h: Column) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), h.alias("h")]


def _ways(texts: DataFrame) -> DataFrame:
    """Where each different document, a (doc_id, h), goes: ``to``, the documents it is next to, with the code points
    they want of it and how many rows they are."""
    keys = texts.groupBy("id", "no_id", "h").agg(
        F.first(F.length("text")).alias("n_chars"), F.count("*").alias("copies"))
    keys = keys.select("*", F.expr("if(no_id, null, id)").alias("doc_id"), F.lit(0).alias("_all"))
    line = stored(ranked(keys, "_all", ["doc_id", "h"], "print-order").drop("_all"), "print-line")
    before = line.select(F.expr("(pos + 1) % size").alias("pos"), F.struct(
        "doc_id", "h", F.expr("n_chars div 2").alias("wanted"), F.lit(1).cast("bigint").alias("times")).alias("_last"))
    self = F.struct("doc_id", "h", F.expr("n_chars div 2").alias("wanted"), (F.col("copies") - 1).alias("times"))
    return line.join(before, "pos").select("id", "no_id", "h", F.filter(
        F.array("_last", self), lambda w: w["times"] > 0).alias("to"))


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next, where the edited text has its last ``n_chars div 2`` code points replaced by the first as
    many of the next document."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = ["id", "no_id", "h"]
    texts = texts.select(*_key(F.col("doc_id"), F.xxhash64("text")), "text")
    ways = _ways(texts)
    # Twelve hex digits travel as six bytes. Both uses read all columns of ``own``, so its exchange is
    # one and the texts are shuffled once.
    own = texts.withColumn("own", F.unhex(fingerprint(F.col("text"), k))).groupBy(*key).agg(
        F.first("text").alias("text"), F.first("own").alias("own"))
    sent = own.join(ways, key).select("text", "own", F.explode("to").alias("to")).select(
        *_key(F.col("to.doc_id"), F.col("to.h")), F.col("to.times").alias("times"),
        F.substring("text", F.lit(1), F.col("to.wanted").cast("int")).alias("added"), F.col("own").alias("next"))
    n_chars = F.length("text").cast("bigint")
    met = own.join(sent, key).select(F.expr("if(no_id, null, id)").alias("doc_id"), "*", n_chars.alias("n_chars"))
    kept = F.substring("text", F.lit(1), F.expr("cast(n_chars - n_chars div 2 as int)"))
    met = met.select("doc_id", "n_chars", "times", F.lower(F.hex("own")).alias("fingerprint"),
                     F.lower(F.hex("next")).alias("next"), F.concat(kept, "added").alias("edited"))
    met = met.select("*", F.sha2("edited", 256).alias("edited_sha256"),
                     fingerprint(F.col("edited"), k).alias("edited_fingerprint"))
    return met.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        resemblance(F.col("fingerprint"), F.col("edited_fingerprint"), k).alias("near_edited"),
        resemblance(F.col("fingerprint"), F.col("next"), k).alias("near_next"),
        F.explode(F.expr("sequence(1L, times)")).alias("_copy")).drop("_copy")
