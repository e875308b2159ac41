"""Catalogue files, landed video items, file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain import schemas
from talkgrain.sources.folders import listed
from talkgrain.sources.listing import listed_by_cores

_EMPTY_METADATA = f"cast(null as {schemas.EPISODE_METADATA_DDL})"


def empty_metadata() -> Column:
    """A metadata struct with no entries, standing for an absent one."""
    fields = "type", "duration_seconds", "transcript_coverage", "speakers"
    inner = ", ".join(f"'{f}', ({_EMPTY_METADATA}).{f}" for f in fields)
    return F.expr(f"named_struct({inner})")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Rows of catalogue documents ``{"episodes": [...]}`` with their ``ordinal``.

    A document that cannot be parsed contributes no rows, as an empty catalogue.
    """
    documents = (
        spark.read.schema(schemas.CATALOGUE_FILE_DDL).option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )
    return catalogue_rows(documents)


def catalogue_rows(documents: DataFrame) -> DataFrame:
    """Rows of parsed catalogue documents, in document order."""
    return typed_episodes(
        documents.select(F.posexplode("episodes").alias("ordinal", "e")).select("ordinal", "e.*")
    )


def read_catalogue_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a catalogue kept as JSON lines, the form that splits across tasks."""
    return typed_episodes(readable(read_lines(spark, path)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of such a catalogue as they are; a line that is not JSON keeps its text in
    ``_corrupt_record`` (see :func:`readable` and :func:`unreadable`)."""
    row = schemas.struct_type(
        f"ordinal: bigint, {schemas.EPISODE_FILE_DDL}, _corrupt_record: string")
    return spark.read.schema(row).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def readable(rows: DataFrame) -> DataFrame:
    """Parsed rows without those that could not be parsed."""
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def unreadable(rows: DataFrame) -> DataFrame:
    """What could not be parsed, whole, for inspection and replay."""
    return rows.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


def typed_episodes(rows: DataFrame) -> DataFrame:
    """ISO text to timestamps, absent metadata and tags to empty ones."""
    return rows.withColumns({
        "published_at": F.try_to_timestamp("published_at"),
        "tags": F.coalesce("tags", F.expr("cast(array() as array<string>)")),
        "metadata": F.coalesce("metadata", empty_metadata()),
    })


def write_catalogue(episodes: DataFrame, new_version: str) -> None:
    """Write a catalogue version into a directory of its own.

    A version that is being read is never overwritten; the caller switches to
    the new directory once the write is committed.
    """
    episodes.write.mode("errorifexists").parquet(new_version)


def write_catalogue_lines(episodes: DataFrame, new_version: str) -> None:
    """Write a catalogue version as JSON lines with ISO timestamps."""
    (
        episodes.withColumn("published_at", iso_text("published_at"))
        .write.mode("errorifexists").option("ignoreNullFields", True).json(new_version)
    )


def iso_text(timestamp: Column | str) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")


def parse_video_items(landed: DataFrame, text: str = "item") -> DataFrame:
    """Parse landed video-API items kept as JSON text; what is not JSON goes to
    ``_corrupt_record``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json(text, schemas.VIDEO_ITEM_DDL, options)
    return landed.select(F.inline(F.array(parsed)))


def read_video_items(spark: SparkSession, path: str) -> DataFrame:
    """Landed video-API items, one JSON object per line."""
    return spark.read.schema(schemas.VIDEO_ITEM_DDL).option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)


def episodes_from_items(items: DataFrame) -> DataFrame:
    """Flatten video items into catalogue rows.

    Counts arrive as text. A missing view count is 0; missing like and comment
    counts stay null, and so does what is not a number. Items that could not be
    parsed or have no id are left out (:func:`unreadable` has the former).
    """
    absent_text = F.lit(None).cast("string")
    if "_corrupt_record" in items.columns:
        items = readable(items)
    return items.where("id is not null").select(
        F.col("id").alias("video_id"),
        F.col("snippet.title").alias("title"),
        F.col("snippet.description").alias("description"),
        F.try_to_timestamp("snippet.publishedAt").alias("published_at"),
        F.col("snippet.channelId").alias("channel_id"),
        F.col("snippet.channelTitle").alias("channel_title"),
        F.coalesce("snippet.tags", F.expr("cast(array() as array<string>)")).alias("tags"),
        F.col("contentDetails.duration").alias("duration"),
        F.coalesce(F.col("statistics.viewCount").try_cast("bigint"), F.lit(0)).alias("view_count"),
        F.col("statistics.likeCount").try_cast("bigint").alias("like_count"),
        F.col("statistics.commentCount").try_cast("bigint").alias("comment_count"),
        F.col("snippet.thumbnails.high.url").alias("thumbnail_url"),
        absent_text.alias("webm_filename"),
        absent_text.alias("audio_filename"),
        absent_text.alias("transcript_filename"),
        F.lit(None).cast("double").alias("transcript_duration"),
        F.lit(None).cast("bigint").alias("transcript_utterances"),
        F.lit(None).cast("bigint").alias("speaker_count"),
        empty_metadata().alias("metadata"),
    )


def playlist_video_ids(items: DataFrame) -> DataFrame:
    """Ids named by playlist items."""
    return items.where("snippet.resourceId.videoId is not null").select(
        F.col("snippet.resourceId.videoId").alias("video_id"))


def read_inventory(spark: SparkSession, directory: str) -> DataFrame:
    """Names and sizes of the files under a directory; contents are not read. A local directory is listed by
    tasks, so that the driver does not hold the status of every file."""
    files = listed(spark, directory)
    if files is None:
        with listed_by_cores(spark):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "path", "length"
    )
