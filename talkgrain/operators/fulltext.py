"""Ranked full-text search over a stored index of positions.

A word is a run of letters, marks and digits, lower-cased; its position is its number in the document. The
same words are indexed, searched for and marked.

The index has one row per word, document and block of ``BLOCK`` positions, with the sorted positions; those
of the next ``HALO`` positions stand in the block as well, so that a phrase never has to be put together from
two blocks. Rows are stored by a hash of the word, so a search reads the directories of its words only. A word
that occurs in every document fills many files, and a long document many rows.

A search takes many queries at once. Words are looked up, filters on the documents' columns applied, the
scores (BM25, from counts over all documents) summed per query and document, and the best kept; a phrase
moreover needs the positions of its words, each moved back by its place in the phrase, to meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{M}\\p{N}]+"
BLOCK = 1 << 14
#: Words of the longest phrase, less one.
HALO = 64
BUCKETS = 64
#: BM25: how soon repeated words stop counting, and how much long documents are held back.
K1, B = 1.2, 0.75


def words(text: Column | str) -> Column:
    """The words of a text in order."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(found, F.lower)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(documents: DataFrame, path: str, *, columns: Sequence[str] = (), block: int = BLOCK, halo: int = HALO) -> None:
    """Index ``documents`` (doc_id, text and the ``columns`` that searches filter by) in the new folder ``path``.

    Ids are unique; documents without id are left out, those without words are never found.
    """
    rows = documents.where("doc_id is not null").select("doc_id", words("text").alias("words"), *columns)
    rows.select("doc_id", F.size("words").cast("bigint").alias("length"), *columns).write.parquet(f"{path}/lengths")
    places = rows.select("doc_id", F.posexplode("words").alias("pos", "term"))
    home = F.expr(f"pos div {block}")
    before = F.when((F.col("pos") >= block) & (F.col("pos") % block < halo), home - 1)
    spread = places.withColumn("block", F.explode(F.array_compact(F.array(home, before))))
    postings = spread.groupBy("term", "doc_id", "block").agg(
        F.sum((home == F.col("block")).cast("bigint")).alias("n"), F.sort_array(F.collect_list("pos")).alias("places"))
    postings = postings.withColumn("bucket", _bucket(F.col("term")))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    postings.repartition("bucket", part).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(
        f"{path}/postings")
    spark = documents.sparkSession
    stored = spark.read.parquet(f"{path}/postings")
    stored.where("n > 0").groupBy("bucket", "term").agg(
        F.count_distinct("doc_id").alias("documents"), F.sum("n").alias("n")).sortWithinPartitions("bucket", "term").write.parquet(
        f"{path}/terms")
    spark.read.parquet(f"{path}/lengths").agg(
        F.count("*").alias("documents"), F.sum("length").alias("words")).write.parquet(f"{path}/totals")
    spark.createDataFrame([(block, halo)], "block bigint, halo int").write.parquet(f"{path}/layout")


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, term, offsets, terms, size): one row per query and different word of it."""
    rows = queries.select("query_id", F.coalesce("phrase", F.lit(False)).alias("phrase"), words("text").alias("words"))
    each = rows.select("query_id", "phrase", F.size("words").alias("size"), F.size(F.array_distinct("words")).alias("terms"),
                       F.posexplode("words").alias("offset", "term"))
    return each.groupBy("query_id", "phrase", "term", "size", "terms").agg(
        F.sort_array(F.collect_list("offset")).alias("offsets"))


def phrases(hits: DataFrame, block: int) -> DataFrame:
    """(query_id, doc_id, starts): where the words of a phrase follow each other."""
    moved = hits.where("phrase").select(
        "query_id", "doc_id", "block", "size", "places", F.explode("offsets").alias("offset")).select(
        "query_id", "doc_id", "block", "size", F.transform("places", lambda p: p - F.col("offset")).alias("starts"))
    met = moved.groupBy("query_id", "doc_id", "block", "size").agg(F.collect_list("starts").alias("all")).where(
        F.size("all") == F.col("size"))
    common = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), F.array_intersect)
    # What begins in the halo is found again as the beginning of the next block.
    own = F.filter(common, lambda p: (p >= F.col("block") * block) & (p < (F.col("block") + 1) * block))
    return met.select("query_id", "doc_id", F.explode(own).alias("start")).groupBy("query_id", "doc_id").agg(
        F.sort_array(F.collect_list("start")).alias("starts"))


def idf(total: Column, documents: Column) -> Column:
    return F.log(1 + (total - documents + 0.5) / (documents + 0.5))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, *, where: Column | str | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score, hits): the ``k`` best documents of each query (query_id, text, phrase)
    among those that ``where``, a condition on the indexed columns, allows.

    A document is found if it has all the words, and with ``phrase`` if it has them in a row; ``hits`` counts
    the words, or the places of the phrase. Scores are told to six digits, ties go by doc_id. Filters do not
    change the counts that scores are made of.
    """
    layout = spark.read.parquet(f"{path}/layout").first()
    total = spark.read.parquet(f"{path}/totals").first()
    asked = _asked(queries).withColumn("bucket", _bucket(F.col("term")))
    if asked.where(F.col("phrase") & (F.col("size") > layout["halo"] + 1)).limit(1).count():
        raise ValueError(f"a phrase may have {layout['halo'] + 1} words")
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    terms = spark.read.parquet(f"{path}/terms").where(F.col("bucket").isin(buckets)).select(
        "term", F.col("documents").alias("df"))
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets)).drop("bucket")
    hits = postings.join(asked.drop("bucket").join(terms, "term"), "term")
    allowed = spark.read.parquet(f"{path}/lengths")
    allowed = (allowed if where is None else allowed.where(where)).select("doc_id", "length")
    often = hits.groupBy("query_id", "doc_id", "term", "phrase", "terms", "df").agg(F.sum("n").alias("n"))
    average = (total["words"] or 0) / max(1, total["documents"])
    held_back = K1 * (1 - B + B * F.col("length") / max(average, 1e-9))
    weight = idf(F.lit(float(total["documents"])), F.col("df")) * F.col("n") * (K1 + 1) / (F.col("n") + held_back)
    scored = often.join(allowed, "doc_id").groupBy("query_id", "doc_id", "phrase", "terms").agg(
        F.round(F.sum(weight), 6).alias("score"), F.sum("n").alias("n"), F.count("*").alias("found")).where(
        F.col("found") == F.col("terms"))
    scored = scored.join(phrases(hits, layout["block"]), ["query_id", "doc_id"], "left").where(
        "not phrase or starts is not null")
    scored = scored.withColumn("hits", F.when(F.col("phrase"), F.size("starts").cast("bigint")).otherwise(F.col("n")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "doc_id", "score", "hits")


def marked_text(text: Column, asked: Column, phrase: Column) -> Column:
    """The text with the words of ``asked`` in brackets; of a phrase, only where its words follow each other."""
    raw = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.split(text, WORD, -1)

    def of(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own)), lambda i: F.slice(own, i + 1, F.size(asked)) == asked)
        inside = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.size(asked) - 1)))
        hit = F.when(phrase, F.transform(own, lambda w, i: F.array_contains(inside, i))).otherwise(
            F.transform(own, lambda w: F.array_contains(asked, w)))
        shown = F.zip_with(raw, hit, lambda w, h: F.when(h, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
        return F.array_join(F.zip_with(gaps, shown, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

    return F.get(F.transform(F.array(F.transform(raw, F.lower)), of), F.lit(0))


def marked(found: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """``found`` with ``marked``, the text with its hits in brackets. Only texts that were found are read on."""
    asked = queries.select("query_id", words("text").alias("_asked"), F.coalesce("phrase", F.lit(False)).alias("_phrase"))
    texts = found.join(documents.select("doc_id", "text"), "doc_id").join(asked, "query_id")
    return texts.select(*found.columns, marked_text(F.col("text"), F.col("_asked"), F.col("_phrase")).alias("marked"))
