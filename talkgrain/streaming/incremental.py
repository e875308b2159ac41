"""Newly landed transcripts and catalogue batches, processed as they arrive.

The transformations are the batch operators; only what the streaming engine
does not allow in row form (neighbours by window) uses the document form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from talkgrain.operators import catalogue, chunks
from talkgrain.plans.ship import ship_package
from talkgrain.sources import transcripts


def chunk_stream(documents: DataFrame, episodes: DataFrame) -> DataFrame:
    """Chunk records of each landed transcript document; stateless.

    ``documents`` (file_name, document) may be a stream or a table; ``episodes``
    is a static catalogue. Unreadable documents are left to
    :func:`rejected_stream`.
    """
    return chunk_parsed(transcripts.parse_transcripts(documents), episodes)


def chunk_parsed(parsed: DataFrame, episodes: DataFrame) -> DataFrame:
    """The same from parsed documents, as ``transcripts.stream_transcripts`` yields them."""
    readable = chunks.readable_documents(transcripts.accepted(parsed))
    return chunks.chunk_documents(chunks.document_chunk_rows(readable, episodes))


def rejected_stream(documents: DataFrame) -> DataFrame:
    """Names of landed documents that give no chunks, and why."""
    return rejected_parsed(transcripts.parse_transcripts(documents))


def rejected_parsed(parsed: DataFrame) -> DataFrame:
    """The same from parsed documents, as ``transcripts.stream_transcripts`` yields them."""
    why = (
        F.when(F.col("_corrupt_record").isNotNull(), "not JSON")
        .when(F.expr(chunks.UNSTAMPED), "no episode metadata")
        .when(F.expr(chunks.UNDATED), "unreadable date")
        .when(F.expr(chunks.INCOMPLETE), "incomplete utterances")
    )
    return parsed.withColumn("reason", why).where("reason is not null").select(
        "file_name", "reason"
    )


def once_each(landed: DataFrame, within: str = "7 days") -> DataFrame:
    """Landed documents (file_name, document, landed_at) without those that landed before, under the same
    name and with the same text, up to ``within`` earlier. A file that landed again changed is kept. State
    is one small row per document, dropped when ``within`` has passed."""
    hashed = landed.withColumn("_text", F.sha2(F.coalesce("document", F.lit("")), 256))
    return hashed.withWatermark("landed_at", within).dropDuplicatesWithinWatermark(["file_name", "_text"]).drop("_text")


def land(documents: DataFrame, episodes: DataFrame, store: str) -> DataStreamWriter:
    """Write the chunks of each micro-batch of landed documents to ``store/chunks/batch=<id>``, and the names
    of those that give none, with the reason, to ``store/rejects/batch=<id>``. A replayed batch overwrites
    its own folders. A document is parsed once for both."""
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = transcripts.parse_transcripts(batch).persist()
        try:
            for name, rows in (("chunks", chunk_parsed(parsed, episodes)), ("rejects", rejected_parsed(parsed))):
                rows.write.mode("overwrite").parquet(f"{store.rstrip('/')}/{name}/batch={batch_id}")
        finally:
            parsed.unpersist()

    return documents.writeStream.foreachBatch(write)


def append_batches(batches: DataFrame, store: str) -> DataStreamWriter:
    """Append the last row per video of each micro-batch, as partition ``batch=<id>`` of a parquet
    table. A batch writes its own rows only; one replayed after a failure overwrites its partition
    with the same rows. Rows carry ``ordinal``, their arrival order."""
    def write(batch: DataFrame, batch_id: int) -> None:
        catalogue.dedup_catalogue(batch).write.mode("overwrite").parquet(
            f"{store.rstrip('/')}/batch={batch_id}")

    return batches.writeStream.foreachBatch(write)


def upserted(base: DataFrame, batches: DataFrame) -> DataFrame:
    """The catalogue as it stands: the last row per video over the base, which may hold a video
    twice, and the appended ``batches`` (with their ``batch`` column)."""
    before = base.withColumn("batch", F.lit(-1))
    if "ordinal" not in base.columns:
        before = before.withColumn("ordinal", F.lit(0).cast("bigint"))
    every = before.unionByName(batches.withColumn("batch", F.col("batch").cast("int")))
    # The row's own text settles what order leaves open, so that every reader sees one row.
    own = [c for c in before.columns if c not in ("batch", "metadata")]
    text = F.xxhash64(*own, *([F.to_json("metadata")] if "metadata" in before.columns else []))
    return catalogue.last_per_video(
        every, F.desc("batch"), F.desc("ordinal"), text).drop("batch", "ordinal")


def fold_batches(base: DataFrame, batches: DataFrame, new_version: str) -> None:
    """Write what :func:`upserted` gives as a new base, in a job of its own."""
    upserted(base, batches).write.mode("errorifexists").parquet(new_version)


def type_counts_by_day(episodes: DataFrame, late: str = "1 day") -> DataFrame:
    """FULL and SHORT episodes per publishing day.

    On a stream, append mode emits a day once ``late`` has passed and frees its
    state; complete mode keeps running counts of all days.
    """
    typed = catalogue.classify(episodes).withWatermark("published_at", late)
    day = F.window("published_at", "1 day")
    return (
        typed.groupBy(day.alias("day"), F.col("metadata.type").alias("type"))
        .agg(F.count("*").alias("episodes"))
        .select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "type", "episodes")
    )


def _nulls_first(row: tuple) -> list[tuple]:
    return [(False, 0) if pd.isna(v) else (True, v) for v in row]


class _LastType(StatefulProcessor):
    """Holds each video's type and day; a changed row takes the old ones back and adds the new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "ordinal bigint, type string, day string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.known.get() if self.known.exists() else None
        last = before
        for part in rows:
            # Plain tuples: a frame is sorted once per video, most of them of one row.
            at = max(zip(*(part[c].tolist() for c in ("ordinal", "type", "day")), strict=True), key=_nulls_first)
            found = (int(at[0]), *at[1:])
            if last is None or found[0] >= last[0]:
                last = found
        if last is not None and last != before:
            self.known.update(last)
        if last is not None and (before is None or tuple(last[1:]) != tuple(before[1:])):
            gone = [(before[1], before[2], -1)] if before else []
            yield pd.DataFrame([*gone, (last[1], last[2], 1)], columns=["type", "day", "change"])

    def close(self) -> None:
        pass


def type_changes(episodes: DataFrame) -> DataFrame:
    """(type, day, change): what each upserted row adds to and takes from the counts per type and publishing day.

    ``episodes`` is a stream of classified catalogue rows with ``ordinal``, their arrival order: of a video's
    rows the one with the largest counts, whatever batch it comes in. State is one row per video; needs
    the RocksDB state store. The changes are kept as they come, and :func:`counted_changes` sums them."""
    ship_package(episodes.sparkSession)
    rows = episodes.select("video_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("metadata.type").alias("type"),
                           F.date_format("published_at", "yyyy-MM-dd").alias("day"))
    return rows.groupBy("video_id").transformWithStateInPandas(
        _LastType(), "type string, day string, change bigint", "append", "None")


def counted_changes(changes: DataFrame) -> DataFrame:
    """(day, type, episodes) from all changes so far."""
    return changes.groupBy("day", "type").agg(F.sum("change").alias("episodes")).where("episodes <> 0")
