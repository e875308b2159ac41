"""Explicit schemas of every table and document the library reads or writes.

Readers never infer: an absent key becomes null, which is what the operators
test for.
"""

from __future__ import annotations

from pyspark.sql import types as T


def struct_type(fields: str) -> T.StructType:
    """The struct of ``name: type`` fields; parsed by the session, so on the driver."""
    return T.DataType.fromDDL(f"struct<{fields}>")


SPEAKER_ENTRY_DDL = (
    "struct<name: string, utterance_count: bigint, confidence: double,"
    " is_guest: boolean, is_unknown: boolean, identified_by_llm: boolean>"
)

EPISODE_METADATA_DDL = (
    "struct<type: string, duration_seconds: bigint, transcript_coverage: double,"
    f" speakers: map<string, {SPEAKER_ENTRY_DDL}>>"
)

# One catalogue row as stored on disk (published_at is ISO text there).
EPISODE_FILE_DDL = (
    "video_id: string, title: string, description: string, published_at: string,"
    " channel_id: string, channel_title: string, tags: array<string>, duration: string,"
    " view_count: bigint, like_count: bigint, comment_count: bigint, thumbnail_url: string,"
    " webm_filename: string, audio_filename: string, transcript_filename: string,"
    " transcript_duration: double, transcript_utterances: bigint, speaker_count: bigint,"
    f" metadata: {EPISODE_METADATA_DDL}"
)

CATALOGUE_FILE_DDL = f"episodes array<struct<{EPISODE_FILE_DDL}>>, _corrupt_record string"

EPISODE_COLUMNS = (
    "video_id", "title", "description", "published_at", "channel_id", "channel_title",
    "tags", "duration", "view_count", "like_count", "comment_count", "thumbnail_url",
    "webm_filename", "audio_filename", "transcript_filename", "transcript_duration",
    "transcript_utterances", "speaker_count", "metadata",
)

UTTERANCE_DDL = (
    "struct<transcript: string, start: double, end: double, speaker: int,"
    " speaker_confidence: double, confidence: double>"
)

WORD_DDL = "struct<word: string, punctuated_word: string, start: double, speaker: int>"

EPISODE_STAMP_DDL = (
    "struct<video_id: string, title: string, published_at: string, duration: string,"
    " duration_seconds: bigint, transcript_duration: double, transcript_coverage: double>"
)

TRANSCRIPT_DOCUMENT_DDL = (
    "results struct<duration: double, transcript: string,"
    f" utterances: array<{UTTERANCE_DDL}>,"
    f" channels: array<struct<alternatives: array<struct<words: array<{WORD_DDL}>>>>>>,"
    " metadata struct<speakers: array<struct<id: int, name: string>>>,"
    f" episode_metadata {EPISODE_STAMP_DDL},"
    " _corrupt_record string"
)

VIDEO_ITEM_DDL = (
    "id string,"
    " snippet struct<title: string, description: string, publishedAt: string,"
    " channelId: string, channelTitle: string, tags: array<string>,"
    " thumbnails: struct<high: struct<url: string>>,"
    " resourceId: struct<videoId: string>>,"
    " contentDetails struct<duration: string>,"
    " statistics struct<viewCount: string, likeCount: string, commentCount: string>,"
    " _corrupt_record string"
)

PERSON_DDL = "struct<name: string, confidence: double, mentioned_in: array<string>>"

SPEAKER_RESPONSE_DDL = f"hosts array<{PERSON_DDL}>, guests array<{PERSON_DDL}>"

CHUNK_DOCUMENT_DDL = (
    "content string, start_time double, end_time double, duration double,"
    " speaker_id int, speaker_confidence double, video_id string, episode_title string,"
    " published_at string, episode_type string, episode_duration bigint,"
    " episode_description string, tags array<string>,"
    " statistics struct<view_count: bigint, like_count: bigint, comment_count: bigint>,"
    " chunk_index bigint, context struct<previous: string, next: string>,"
    " confidence_score double, chunk_id string, timestamp double,"
    " metadata struct<year: int, month: int, day: int, duration_seconds: double,"
    " confidence_tier: string, episode_type: string, has_tags: boolean,"
    " engagement_metrics: struct<views: bigint, likes: bigint, comments: bigint>>"
)
