"""Transcript documents: read, parse, explode, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain import schemas
from talkgrain.plans import blocks
from talkgrain.sources.catalogue import iso_text
from talkgrain.sources.folders import write_folders
from talkgrain.sources.listing import listed_by_cores


def read_transcripts(
    spark: SparkSession, directory: str, *, names: str = "*.json", deep: bool = False
) -> DataFrame:
    """One row per transcript file, with its ``file_name``.

    A file that is not valid JSON keeps its text in ``_corrupt_record``; see
    :func:`accepted` and :func:`rejected`. ``deep`` reads the files of all folders below, whatever their
    names; else the driver parses each ``name=value`` folder for a column, some 0.2 ms of one core's time.
    """
    with listed_by_cores(spark):
        return _documents(spark.read, directory, names, deep)


def stream_transcripts(
    spark: SparkSession, directory: str, *, names: str = "*.json", per_trigger: int = 1000, deep: bool = False
) -> DataFrame:
    """The same rows as a stream of the files that land in a directory."""
    with listed_by_cores(spark):
        return _documents(spark.readStream.option("maxFilesPerTrigger", per_trigger), directory, names, deep)


def stream_documents(spark: SparkSession, directory: str, *, names: str = "*.json", per_trigger: int = 1000) -> DataFrame:
    """Transcript files as they land, as texts: (file_name, document, landed_at). ``landed_at`` is the
    time the file was written."""
    files = spark.readStream.option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", names).option(
        "recursiveFileLookup", True).option("wholetext", True).text(directory)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("document"),
                        F.col("_metadata.file_modification_time").alias("landed_at"))


def _documents(reader, directory: str, names: str, deep: bool) -> DataFrame:
    if deep:
        reader = reader.option("recursiveFileLookup", True)
    return (
        reader.schema(schemas.TRANSCRIPT_DOCUMENT_DDL).option("multiLine", True)
        .option("pathGlobFilter", names).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(directory)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def parse_transcripts(landed: DataFrame, text: str = "document", *, whole: bool = False) -> DataFrame:
    """The same columns from transcripts landed as JSON text in a table.

    ``inline`` parses each document once: the columns it yields are not replaced
    by the parsing expression in filters and lambdas further up. ``whole`` adds the document
    as it is, as a VARIANT of that name, for :func:`as_json` to write keys that the
    schema does not name.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json(text, schemas.TRANSCRIPT_DOCUMENT_DDL, options)
    beside = [F.try_parse_json(text).alias("whole")] if whole else []
    return landed.select("file_name", *beside, F.inline(F.array(parsed)))


def accepted(transcripts: DataFrame) -> DataFrame:
    return transcripts.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def rejected(transcripts: DataFrame) -> DataFrame:
    """Files that could not be parsed, whole, for inspection and replay."""
    return transcripts.where(F.col("_corrupt_record").isNotNull()).select(
        "file_name", "_corrupt_record"
    )


def name_by_file(transcripts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Add ``video_id``: of the episode whose ``transcript_filename`` the document has, else the one
    the document states itself."""
    named = episodes.where("coalesce(transcript_filename, '') <> ''").groupBy(
        F.col("transcript_filename").alias("file_name")).agg(F.min("video_id").alias("_named"))
    return transcripts.join(named, "file_name", "left").withColumn(
        "video_id", F.coalesce("_named", "episode_metadata.video_id")).drop("_named")


def _video_id(transcripts: DataFrame):
    """The id that :func:`name_by_file` found, or the document's own."""
    return F.col("video_id" if "video_id" in transcripts.columns else "episode_metadata.video_id")


def utterances(transcripts: DataFrame) -> DataFrame:
    """Utterance rows in array order."""
    return (
        transcripts
        .select(
            _video_id(transcripts).alias("video_id"), "file_name",
            F.posexplode("results.utterances").alias("pos", "u"),
        )
        .select("video_id", "file_name", F.col("pos").cast("bigint").alias("pos"), "u.*")
    )


def words(transcripts: DataFrame) -> DataFrame:
    """Word rows of the first alternative of the first channel.

    A transcript without any keeps one row whose ``pos`` is null.
    """
    first = "get(get(results.channels, 0).alternatives, 0).words"
    return (
        transcripts
        .select(
            _video_id(transcripts).alias("video_id"), "file_name",
            F.posexplode_outer(F.expr(first)).alias("pos", "w"),
        )
        .select("video_id", "file_name", F.col("pos").cast("bigint").alias("pos"), "w.*")
    )


def speaker_names(transcripts: DataFrame) -> DataFrame:
    """Names a transcript itself gives its speakers."""
    return (
        transcripts
        .select(F.col("episode_metadata.video_id").alias("video_id"),
                F.explode("metadata.speakers").alias("s"))
        .select("video_id", F.col("s.id").alias("speaker"), F.col("s.name").alias("name"))
    )


def attach_episode_metadata(transcripts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Stamp each transcript of a known episode with its metadata, if it has none.

    ``transcripts`` carries the ``video_id`` its file is named after. Transcripts
    of unknown episodes are left out.
    """
    stamp = F.struct(
        "video_id", "title", iso_text("published_at").alias("published_at"), "duration",
        F.col("metadata.duration_seconds").alias("duration_seconds"), "transcript_duration",
        F.col("metadata.transcript_coverage").alias("transcript_coverage"),
    )
    stamps = episodes.select("video_id", stamp.alias("_stamp"))
    return (
        transcripts.join(stamps, "video_id")
        .withColumn("episode_metadata", F.coalesce("episode_metadata", "_stamp"))
        .drop("_stamp")
    )


def as_json(transcripts: DataFrame) -> DataFrame:
    """Each transcript as one JSON text, absent keys left out.

    Rows with their ``whole`` document are written with all its keys, known or not; metadata attached to a
    document that had none is added to them. Numbers keep their value, not their spelling.
    """
    if "whole" in transcripts.columns:
        stamp = F.parse_json(F.to_json("episode_metadata", {"ignoreNullFields": "true"}))
        others = F.map_filter(F.col("whole").cast("map<string,variant>"), lambda k, _: k != "episode_metadata")
        own = F.try_variant_get("whole", "$.episode_metadata", "variant")
        added = F.to_json(F.map_concat(others, F.create_map(F.lit("episode_metadata"), stamp)))
        unstamped = own.isNull() | F.is_variant_null(own)
        return transcripts.select("file_name", F.when(
            F.col("episode_metadata").isNotNull() & unstamped, added).otherwise(F.to_json("whole")).alias("document"))
    document = F.struct("results", "metadata", "episode_metadata")
    return transcripts.select(
        "file_name", F.to_json(document, {"ignoreNullFields": "true"}).alias("document")
    )


def write_chunks(
    chunks: DataFrame, directory: str, *, by: str = "month", co_located: bool = False
) -> None:
    """Write chunk documents as JSON, one directory per month or per video.

    By month the directories stay few for a catalogue of millions; by video they
    suit readers that look up one video. Rows are rebalanced on the directory first:
    small directories get one file, large ones are split over tasks. Rows out of
    ``operators.chunks.enrich`` already lie by stretches of a video;
    ``co_located`` then saves the shuffle.
    """
    folders = {"video": {"video": F.col("video_id")},
               "month": {"year": F.col("metadata.year"), "month": F.col("metadata.month")}}[by]
    rows = chunks.withColumns(folders)
    if not co_located:
        rows = rows.hint("rebalance", *folders)
    rows.write.mode("errorifexists").partitionBy(*folders).json(directory)


def read_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNK_DOCUMENT_DDL).json(directory).drop(
        "video", "year", "month"
    )


def write_readable(lines: DataFrame, directory: str) -> None:
    """Write rendered lines (video_id, line_no, line) as text, in line order.

    A video is a directory with one file, or one numbered part per stretch of a
    very long video, so no task writes a whole recording of unbounded length.
    """
    part = F.greatest(blocks.block_of("line_no"), F.lit(0).cast("bigint"))
    rows = lines.withColumn("part", part).repartition("video_id", "part")
    write_folders(rows, directory, ("video_id", "part"), "line", ("line_no",))


def read_readable(spark: SparkSession, directory: str) -> DataFrame:
    """Rendered lines; video id and part come from the directory names."""
    with listed_by_cores(spark):
        return spark.read.schema("line string, video_id string, part bigint").text(directory)
