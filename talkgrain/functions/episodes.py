"""Column expressions on catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds from which an episode counts as full, and its two types.
MIN_FULL_SECONDS = 180
FULL = "FULL"
SHORT = "SHORT"

# Phrases that announce a guest, in order of preference.
GUEST_PHRASES = ("with ", "featuring ", "guest ", "welcomes ")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_set(c: Column | str) -> Column:
    """True when a text column is neither null nor empty."""
    return F.coalesce(_col(c), F.lit("")) != ""


def duration_seconds(duration: Column | str) -> Column:
    """Seconds of an ISO-8601 duration; hours, minutes and seconds only."""
    text = _col(duration)

    def unit(letter: str, seconds: int) -> Column:
        digits = F.regexp_extract(text, rf"(\d+){letter}", 1).try_cast("bigint")
        return F.coalesce(digits, F.lit(0)) * seconds

    return unit("H", 3600) + unit("M", 60) + unit("S", 1)


def episode_type(seconds: Column | str, min_seconds: int = MIN_FULL_SECONDS) -> Column:
    """FULL from ``min_seconds`` on, SHORT below."""
    return F.when(_col(seconds) >= min_seconds, FULL).otherwise(SHORT)


def clock(seconds: Column | str) -> Column:
    """Seconds as ``h:mm:ss``, with a leading day count from 24 hours on."""
    s = _col(seconds)
    days, rest = F.floor(s / 86400), s % 86400
    hms = F.concat_ws(
        ":",
        F.floor(rest / 3600).cast("string"),
        F.lpad(F.floor(rest % 3600 / 60).cast("string"), 2, "0"),
        F.lpad((rest % 60).cast("string"), 2, "0"),
    )
    plural = F.when(days == 1, " day, ").otherwise(" days, ")
    return F.when(days > 0, F.concat(days.cast("string"), plural, hms)).otherwise(hms)


def coverage_percent(transcript_seconds: Column | str, seconds: Column | str) -> Column:
    """Transcribed share of an episode, at most 100; null if either is absent or 0."""
    t, s = _col(transcript_seconds), _col(seconds)
    share = F.round(F.least(F.lit(100.0), t / s * 100), 2)
    return F.when((t != 0) & (s != 0), share)


def estimated_speakers(utterances: Column | str) -> Column:
    """One speaker per ten utterances, between 1 and 4."""
    tens = F.floor(_col(utterances) / 10)
    return F.least(F.lit(4), F.greatest(F.lit(1), tens)).cast("bigint")


def transcript_name(audio_name: Column | str) -> Column:
    """Transcript file of an audio file: last extension replaced by ``.json``."""
    return F.concat(F.regexp_replace(_col(audio_name), r"\.[^.]*$", ""), F.lit(".json"))


def audio_name(video_id: Column | str, audio_format: str = "mp3") -> Column:
    """Audio file of an episode."""
    return F.concat(_col(video_id), F.lit("." + audio_format))


def guest_hint(description: Column | str) -> Column:
    """(phrase, name) of who is announced in a description, or null.

    For each phrase in order: the text after its first occurrence, up to its
    next occurrence and then the first of ``.``, ``,``, ``!``; it counts if more
    than three characters remain after trimming.
    """
    text = F.lower(_col(description))

    def after(phrase: str) -> Column:
        tail = F.regexp_extract(text, phrase + "([^.,!]*)", 1)
        name = F.btrim(F.substring_index(tail, phrase, 1), F.lit(" \t\n\r"))
        return F.when(F.length(name) > 3, F.struct(
            F.lit(phrase).alias("phrase"), name.alias("name")))

    return F.coalesce(*[after(p) for p in GUEST_PHRASES])


def matches_text(query: str, *columns: str) -> Column:
    """Case-insensitive literal substring in any of the columns."""
    wanted = F.lower(F.lit(query))
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), wanted), F.lit(False))
    return found
