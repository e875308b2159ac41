"""Verification report over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import episodes as E

HAS_SPEAKERS = "coalesce(size(metadata.speakers), 0) > 0"


def verify_stats(episodes: DataFrame) -> DataFrame:
    """One row of counters and percentages, in a single aggregation.

    The percentages are null for an empty catalogue.
    """
    counts = episodes.agg(
        F.count("*").alias("total_episodes"),
        F.count_if(F.col("metadata.type") == E.FULL).alias("full_episodes"),
        F.count_if(F.col("metadata.type") == E.SHORT).alias("shorts"),
        F.count_if(E.is_set("audio_filename")).alias("with_audio"),
        F.count_if(E.is_set("transcript_filename")).alias("with_transcript"),
        F.count_if(F.expr(HAS_SPEAKERS)).alias("with_speakers"),
    )
    return counts.withColumns({
        f"{what}_percent": F.expr(f"round(try_divide(100D * with_{what}, total_episodes), 1)")
        for what in ("audio", "transcript", "speakers")
    })


def verify_missing(episodes: DataFrame, shown: int = 10) -> DataFrame:
    """What each category lacks: the first ``shown`` episodes and how many more.

    Counting is combined map-side and the rank filter also runs before the
    shuffle, so no task sees a whole category.
    """
    lacking = episodes.select(
        "video_id",
        "title",
        "published_at",
        F.explode(
            F.expr(
                "array_compact(array("
                " if(coalesce(audio_filename, '') = '', 'audio', null),"
                " if(coalesce(transcript_filename, '') = '', 'transcript', null),"
                f" if({HAS_SPEAKERS}, null, 'speakers')))"
            )
        ).alias("category"),
    )
    order = Window.partitionBy("category").orderBy(F.desc("published_at"), "video_id")
    first = lacking.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    counts = lacking.groupBy("category").agg(F.count("*").alias("missing"))
    return first.join(counts, "category").select(
        "category", "rank", "video_id", "title", "missing",
        F.greatest(F.col("missing") - shown, F.lit(0)).alias("more"),
    )
