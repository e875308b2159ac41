"""Operators on the episode catalogue: selection, classification, upserts, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import episodes as E
from talkgrain.schemas import EPISODE_COLUMNS

METADATA_IS_SET = (
    "coalesce({0}.type, cast({0}.duration_seconds as string),"
    " cast({0}.transcript_coverage as string), if({0}.speakers is null, null, '')) is not null"
)


def newest_first() -> tuple[Column, Column]:
    return F.desc("published_at"), F.asc("video_id")


# -- selection ---------------------------------------------------------------

def episode_by_id(episodes: DataFrame, video_id: str) -> DataFrame:
    return episodes.where(F.col("video_id") == video_id)


def episodes_by_ids(episodes: DataFrame, ids: str) -> DataFrame:
    """Episodes named in a comma list; blanks are trimmed, unknown ids ignored."""
    wanted = [i.strip() for i in ids.split(",") if i.strip()]
    return episodes.where(F.col("video_id").isin(wanted))


def search_episodes(episodes: DataFrame, query: str) -> DataFrame:
    """Episodes whose title or description contains ``query`` literally."""
    return episodes.where(E.matches_text(query, "title", "description"))


def classify(episodes: DataFrame, min_seconds: int = E.MIN_FULL_SECONDS) -> DataFrame:
    """Write ``duration_seconds`` and ``type`` into the metadata of each episode."""
    seconds = E.duration_seconds("duration")
    return (
        episodes.withColumn("_s", seconds)
        .withColumn(
            "metadata",
            F.col("metadata")
            .withField("duration_seconds", F.col("_s"))
            .withField("type", E.episode_type("_s", min_seconds)),
        )
        .drop("_s")
    )


def of_type(episodes: DataFrame, wanted: str = E.FULL) -> DataFrame:
    return episodes.where(F.col("metadata.type") == wanted)


def latest(episodes: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` newest episodes; 0 or less means all of them."""
    return episodes.orderBy(*newest_first()).limit(limit) if limit > 0 else episodes


def needs_download(episodes: DataFrame, full_only: bool = True) -> DataFrame:
    return of_type(episodes) if full_only else episodes


def needs_convert(episodes: DataFrame) -> DataFrame:
    return episodes.where(E.is_set("webm_filename"))


def needs_transcribe(episodes: DataFrame) -> DataFrame:
    return episodes.where(E.is_set("audio_filename"))


def needs_speakers(episodes: DataFrame, force: bool = False) -> DataFrame:
    """Transcribed episodes without speakers, or all transcribed ones."""
    transcribed = episodes.where(E.is_set("transcript_filename"))
    return transcribed if force else transcribed.where("metadata.speakers is null")


def derived_filenames(episodes: DataFrame, audio_format: str = "mp3") -> DataFrame:
    """Names the audio and transcript files of each episode get."""
    return episodes.select(
        "video_id",
        E.audio_name("video_id", audio_format).alias("audio_name"),
        E.transcript_name("audio_filename").alias("transcript_name"),
    )


# -- listing and summaries ---------------------------------------------------

def listing(classified: DataFrame) -> DataFrame:
    """Id, clock duration, type and short title; ``part`` puts FULL before SHORT."""
    return classified.select(
        F.when(F.col("metadata.type") == E.FULL, 0).otherwise(1).alias("part"),
        "video_id",
        E.clock("metadata.duration_seconds").alias("duration"),
        F.col("metadata.type").alias("type"),
        F.substring("title", 1, 40).alias("title"),
    )


def type_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.col("metadata.type").alias("type")).agg(
        F.count("*").alias("episodes")
    )


# -- maintenance -------------------------------------------------------------

def last_per_video(rows: DataFrame, *newest_first: Column) -> DataFrame:
    """One row per video, the first in the given order.

    The rank filter runs before the shuffle as well as after it, so a video
    with very many versions sends one row per task.
    """
    window = Window.partitionBy("video_id").orderBy(*newest_first)
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def dedup_catalogue(rows: DataFrame) -> DataFrame:
    """Last row per video by ``ordinal``."""
    return last_per_video(rows, F.desc("ordinal"))


def upsert(stored: DataFrame, batch: DataFrame, *, unique: bool = False) -> DataFrame:
    """Replace whole rows by key and append new ones; the last of a key wins.

    Both sides carry ``ordinal``, their own order. Where the stored catalogue is
    known to have one row per video, as every result of an upsert has, ``unique``
    leaves its rows where they are: only the batch is ranked, and stored rows it
    replaces are dropped by an anti join, without a shuffle for a small batch.
    """
    if unique:
        new = dedup_catalogue(batch)
        kept = stored.join(batch.select("video_id"), "video_id", "left_anti")
        return kept.drop("ordinal").unionByName(new.drop("ordinal"))
    both = stored.withColumn("_source", F.lit(0)).unionByName(
        batch.withColumn("_source", F.lit(1))
    )
    latest_rows = last_per_video(both, F.desc("_source"), F.desc("ordinal"))
    return latest_rows.drop("_source", "ordinal")


def update_existing(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace stored rows that have an update; nulls of the update count.

    Updates of unknown videos change nothing; :func:`unmatched_updates` lists them.
    """
    new = last_per_video(updates, F.desc("ordinal")).drop("ordinal")
    new = new.withColumn("_hit", F.lit(True))
    joined = stored.alias("b").join(new.alias("u"), "video_id", "left")
    columns = [c for c in stored.columns if c not in ("video_id", "ordinal")]
    replaced = [
        F.when(F.col("u._hit"), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        if c in new.columns else F.col(f"b.{c}")
        for c in columns
    ]
    return joined.select("video_id", *replaced)


def unmatched_updates(stored: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.select("video_id").distinct().join(stored, "video_id", "left_anti")


def upsert_keeping_metadata(
    stored: DataFrame,
    batch: DataFrame,
    kept: tuple[str, ...] = ("metadata",),
    *,
    unique: bool = False,
) -> DataFrame:
    """Upsert where columns in ``kept`` keep their stored value if there is one.

    ``kept`` may name file and transcript columns too, so that re-fetching an
    episode does not undo the stages it already went through.
    """
    new = dedup_catalogue(batch).drop("ordinal")
    if not unique:
        stored = dedup_catalogue(stored)
    columns = [c for c in EPISODE_COLUMNS if c in stored.columns]
    new = new.select(*[F.col(c).alias(f"_new_{c}") if c != "video_id" else F.col(c) for c in columns],
                     F.lit(True).alias("_hit"))

    def value(c: str) -> Column:
        if c == "metadata" and c in kept:
            fresh = F.when(F.expr(METADATA_IS_SET.format(c)), F.col(c)).otherwise(F.col(f"_new_{c}"))
        elif c in kept:
            fresh = F.coalesce(c, f"_new_{c}")
        else:
            fresh = F.col(f"_new_{c}")
        return F.when(F.col("_hit"), fresh).otherwise(F.col(c)).alias(c)

    # One join finds old and new rows together: a full one, in which a missing stored row has no values.
    both = stored.select(*columns).join(new, "video_id", "full")
    return both.select("video_id", *[value(c) for c in columns if c != "video_id"])


# -- files -------------------------------------------------------------------

FILE_COLUMNS = ("audio_filename", "transcript_filename")


def missing_files(episodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """(video_id, kind, file_name) of named files the inventory lacks."""
    named = episodes.select(
        "video_id",
        F.expr(
            "stack(2, 'audio', audio_filename, 'transcript', transcript_filename)"
            " as (kind, file_name)"
        ),
    ).where(E.is_set("file_name"))
    return named.join(inventory.select("file_name"), "file_name", "left_anti").select(
        "video_id", "kind", "file_name"
    )


def without_missing_files(episodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """The catalogue with the names of missing files set to null.

    The missing names are found on the narrow columns and folded to one row per
    video; the wide rows meet that small set once.
    """
    gone = missing_files(episodes, inventory).groupBy("video_id").agg(
        *[F.bool_or(F.col("kind") == k).alias(f"_{k}") for k in ("audio", "transcript")])
    cleared = {c: F.when(~F.coalesce(f"_{k}", F.lit(False)), F.col(c))
               for c, k in zip(FILE_COLUMNS, ("audio", "transcript"), strict=True)}
    return episodes.join(gone, "video_id", "left").withColumns(cleared).drop("_audio", "_transcript")


def with_existing_file(
    episodes: DataFrame, inventory: DataFrame, column: str = "audio_filename", limit: int = 0
) -> DataFrame:
    """Episodes whose named file exists, newest first when limited."""
    files = inventory.select(F.col("file_name").alias(column))
    return latest(episodes.join(files, column, "left_semi"), limit)


# -- transcript facts of an episode ------------------------------------------

def with_coverage(episodes: DataFrame) -> DataFrame:
    """Fill ``metadata.transcript_coverage`` where both durations are known."""
    share = E.coverage_percent("transcript_duration", "metadata.duration_seconds")
    return episodes.withColumn(
        "metadata", F.col("metadata").withField("transcript_coverage", share)
    )


def with_speaker_estimate(episodes: DataFrame) -> DataFrame:
    """Estimate ``speaker_count`` from the utterance count where it is not known.

    Only where coverage can be computed and there are utterances at all.
    """
    known = (F.col("transcript_duration") != 0) & (F.col("metadata.duration_seconds") != 0)
    unset = F.coalesce("speaker_count", F.lit(0)) == 0
    fill = known & (F.col("transcript_utterances") != 0) & unset
    return episodes.withColumn(
        "speaker_count",
        F.when(fill, E.estimated_speakers("transcript_utterances"))
        .otherwise(F.col("speaker_count")),
    )
