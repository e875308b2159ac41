"""Column expressions on transcripts, chunks and rendered lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Snippet length, tier limits, chunk size.
SNIPPET_CHARS = 100
HIGH_CONFIDENCE = 0.9
MEDIUM_CONFIDENCE = 0.7
MAX_CHUNK_CHARS = 512

# Label forms (and what replaces them) that displaying a rendered
# transcript can hide: the bracketed forms, and those ``turn_line`` writes.
SPEAKER_LABELS = ((r"\[Speaker \d+\]: ", ""), (r"(?m)^(\[\d+\.\d\] )[^:\n]+: ", "$1"))
TIME_LABELS = ((r"\[\d{2}:\d{2}:\d{2}\] ", ""), (r"(?m)^\[\d+\.\d\] ", ""))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def snippet(text: Column | str, chars: int = SNIPPET_CHARS) -> Column:
    """The text itself, or its first ``chars`` characters and three dots."""
    t = _col(text)
    cut = F.concat(F.substring(t, 1, chars), F.lit("..."))
    return F.when(F.length(t) <= chars, t).otherwise(cut)


def confidence_tier(score: Column | str) -> Column:
    """high / medium / low, judged on the unrounded score."""
    s = _col(score)
    return (
        F.when(s > HIGH_CONFIDENCE, "high").when(s > MEDIUM_CONFIDENCE, "medium").otherwise("low")
    )


def chunk_id(video_id: Column | str, index: Column | str) -> Column:
    return F.concat_ws("_", _col(video_id), _col(index).cast("string"))


def one_decimal(number: Column | str) -> Column:
    """A number with one decimal and no grouping (ties as binary values round)."""
    return F.replace(F.format_number(_col(number), 1), F.lit(","), F.lit(""))


def two_decimals(number: Column | str) -> Column:
    return F.replace(F.format_number(_col(number), 2), F.lit(","), F.lit(""))


def speaker_tag(speaker: Column | str) -> Column:
    """``Speaker`` and the id; an absent speaker is shown as ``None``."""
    shown = F.coalesce(_col(speaker).cast("string"), F.lit("None"))
    return F.concat(F.lit("Speaker "), shown)


def turn_line(start: Column | str, name: Column | str, text: Column | str) -> Column:
    return F.concat(
        F.lit("["), one_decimal(start), F.lit("] "), _col(name), F.lit(": "), _col(text)
    )


def word_text(punctuated: Column | str, word: Column | str) -> Column:
    return F.coalesce(_col(punctuated), _col(word), F.lit(""))


def hide_labels(
    text: Column | str, *, show_speakers: bool = True, show_timestamps: bool = False
) -> Column:
    """A rendered transcript (or one line of it) without speaker / time labels."""
    shown = _col(text)
    labels: tuple[tuple[str, str], ...] = ()
    if not show_speakers:
        labels += SPEAKER_LABELS
    if not show_timestamps:
        labels += TIME_LABELS
    for pattern, kept in labels:
        shown = F.regexp_replace(shown, pattern, kept)
    return shown


def role_label(is_unknown: Column | str, is_guest: Column | str) -> Column:
    return F.when(_col(is_unknown), "UNKNOWN").when(_col(is_guest), "GUEST").otherwise("HOST")
