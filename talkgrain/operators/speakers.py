"""Speakers of a transcript: statistics, candidate names, assignment, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain import schemas
from talkgrain.functions import transcripts as X

# Samples kept per speaker, and the confidence of an unstated,
# or an unknown, name.
SAMPLES_PER_SPEAKER = 10
HOST_CONFIDENCE = 0.8
GUEST_CONFIDENCE = 0.7
UNKNOWN_CONFIDENCE = 0.1


def speaker_stats(utterances: DataFrame) -> DataFrame:
    """Utterances per (video_id, speaker) and where the speaker first appears.

    The null test on the id is what later joins would add on one side only; said
    here, every use of the result has the same plan and shares its shuffle.
    """
    return (
        utterances.where("speaker is not null and video_id is not null")
        .groupBy("video_id", "speaker")
        .agg(F.count("*").alias("utterance_count"), F.min("pos").alias("first_pos"))
        .withColumn("speaker_tag", X.speaker_tag("speaker"))
    )


def stats_in_document(transcripts: DataFrame, size: int = SAMPLES_PER_SPEAKER) -> DataFrame:
    """Statistics and samples of each speaker straight from transcript documents, without a shuffle.

    Gives (video_id, speaker, utterance_count, first_pos, speaker_tag, samples).
    """
    said = "filter(coalesce(results.utterances, array()), u -> u.speaker is not null)"
    who = "array_distinct(transform(said, u -> u.speaker))"
    rows = transcripts.select(
        F.col("episode_metadata.video_id").alias("video_id"),
        F.expr("coalesce(results.utterances, array())").alias("us"), F.expr(said).alias("said"),
    ).select("video_id", "us", "said", F.explode(F.expr(who)).alias("speaker"))
    own = "filter(said, u -> u.speaker = speaker)"
    return rows.select("video_id", "speaker", F.expr(own).alias("own"), "us").select(
        "video_id", "speaker", F.size("own").cast("bigint").alias("utterance_count"),
        F.expr("cast(array_position(transform(us, u -> u.speaker), speaker) - 1 as bigint)")
        .alias("first_pos"),
        X.speaker_tag("speaker").alias("speaker_tag"),
        F.expr(f"slice(transform(filter(own, u -> u.transcript is not null), u -> u.transcript), 1, {size})")
        .alias("samples"),
    )


def speaker_samples(utterances: DataFrame, size: int = SAMPLES_PER_SPEAKER) -> DataFrame:
    """The first ``size`` texts of each speaker, in order.

    The rank filter also runs before the shuffle, so at most ``size`` rows per
    speaker leave each task.
    """
    order = Window.partitionBy("video_id", "speaker").orderBy("pos")
    first = (
        utterances.where("speaker is not null and transcript is not null")
        .select("video_id", "speaker", "pos", "transcript")
        .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= size)
    )
    texts = F.sort_array(F.collect_list(F.struct("pos", "transcript")))
    return first.groupBy("video_id", "speaker").agg(
        F.transform(texts, lambda x: x["transcript"]).alias("samples")
    )


def speaker_count(utterances: DataFrame) -> DataFrame:
    return utterances.groupBy("video_id").agg(
        F.count_distinct("speaker").alias("speaker_count")
    )


def transcript_stats(utterances: DataFrame) -> DataFrame:
    """Utterance total and covered seconds of each transcript in row form."""
    return utterances.groupBy("video_id").agg(
        F.count("*").alias("transcript_utterances"),
        F.max("end").alias("transcript_duration"),
    )


def document_stats(transcripts: DataFrame) -> DataFrame:
    """The same two facts as transcript documents state them."""
    return transcripts.select(
        F.col("episode_metadata.video_id").alias("video_id"),
        F.coalesce(F.size("results.utterances"), F.lit(0)).cast("bigint")
        .alias("transcript_utterances"),
        F.col("results.duration").alias("transcript_duration"),
    )


def ranked_speakers(stats: DataFrame) -> DataFrame:
    """Most talkative first, ties by first appearance."""
    order = Window.partitionBy("video_id").orderBy(F.desc("utterance_count"), F.asc("first_pos"))
    return stats.withColumn("speaker_rank", F.row_number().over(order).cast("bigint"))


# -- answers -----------------------------------------------------------------

def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """Hosts and guests named by an answer: JSON, JSON inside prose, or nothing."""
    whole = F.col(text)
    inner = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)

    def usable(c: Column) -> Column:
        return F.when(F.try_parse_json(c).isNotNull(), c)

    parsed = F.from_json(F.coalesce(usable(whole), usable(inner)), schemas.SPEAKER_RESPONSE_DDL)
    nobody = F.expr(f"cast(array() as array<{schemas.PERSON_DDL}>)")
    return responses.select("video_id", F.inline(F.array(parsed))).select(
        "video_id",
        F.coalesce("hosts", nobody).alias("hosts"),
        F.coalesce("guests", nobody).alias("guests"),
    )


def candidate_names(parsed: DataFrame) -> DataFrame:
    """(video_id, kind, name, confidence, name_rank): distinct names per kind.

    A repeated name keeps its first position and its last confidence. Lists are
    collapsed inside the row they came in.
    """
    def people(kind: str, column: str, default: float) -> DataFrame:
        return parsed.select(
            "video_id", F.lit(kind).alias("kind"), F.posexplode(column).alias("ord", "p")
        ).select(
            "video_id", "kind", "ord", F.col("p.name").alias("name"),
            F.coalesce("p.confidence", F.lit(default)).alias("confidence"),
        )

    named = people("host", "hosts", HOST_CONFIDENCE).unionByName(
        people("guest", "guests", GUEST_CONFIDENCE)
    ).where("coalesce(name, '') <> ''")
    collapsed = named.groupBy("video_id", "kind", "name").agg(
        F.min("ord").alias("ord"), F.max_by("confidence", "ord").alias("confidence")
    )
    order = Window.partitionBy("video_id", "kind").orderBy("ord")
    return collapsed.withColumn("name_rank", F.row_number().over(order)).drop("ord")


def assign_names(stats: DataFrame, candidates: DataFrame) -> DataFrame:
    """Give each speaker a host name, a guest name, or an unknown one.

    Hosts go to the most talkative speakers in order; guests to the speakers
    still unnamed, in order of appearance.
    """
    # Names by rank, folded to one row per video: everything then meets on video_id.
    named = candidates.groupBy("video_id").agg(*[
        F.map_from_entries(F.collect_list(F.when(
            F.col("kind") == kind, F.struct("name_rank", F.struct("name", "confidence")))))
        .alias(f"_{kind}s") for kind in ("host", "guest")])
    ranked = ranked_speakers(stats).join(named, "video_id", "left").withColumn(
        "_host", F.expr("_hosts[cast(speaker_rank as int)]"))
    unnamed = F.col("_host").isNull()
    # Counted over all speakers, a speaker's rank among the unnamed ones so far.
    so_far = Window.partitionBy("video_id").orderBy("first_pos")
    free = F.sum(F.when(unnamed, 1).otherwise(0)).over(so_far)
    both = ranked.withColumn("_free", free).withColumn(
        "_guest", F.when(unnamed, F.expr("_guests[cast(_free as int)]"))).select(
        "*", F.col("_host.name").alias("host_name"), F.col("_host.confidence").alias("host_confidence"),
        F.col("_guest.name").alias("guest_name"), F.col("_guest.confidence").alias("guest_confidence"))
    is_guest = unnamed & F.col("guest_name").isNotNull()
    is_unknown = unnamed & F.col("guest_name").isNull()
    unknown = F.concat(F.lit("Unknown Speaker "), F.col("speaker").cast("string"))
    return both.select(
        "video_id",
        "speaker",
        "speaker_tag",
        "utterance_count",
        "first_pos",
        F.coalesce("host_name", "guest_name", unknown).alias("name"),
        F.when(~unnamed, F.col("host_confidence"))
        .when(is_guest, F.col("guest_confidence"))
        .otherwise(UNKNOWN_CONFIDENCE).alias("confidence"),
        is_guest.alias("is_guest"),
        is_unknown.alias("is_unknown"),
        (~is_unknown).alias("identified_by_llm"),
    )


def with_role(assigned: DataFrame) -> DataFrame:
    return assigned.withColumn("role", X.role_label("is_unknown", "is_guest"))


# -- maps on the catalogue ---------------------------------------------------

def speakers_map(assigned: DataFrame) -> DataFrame:
    """(video_id, speakers): assigned speakers folded into a map by speaker id.

    A speaker given more than once keeps the entry with the most utterances.
    """
    entry = F.struct(
        F.col("speaker").cast("string").alias("key"),
        F.struct("name", "utterance_count", "confidence", "is_guest", "is_unknown",
                 "identified_by_llm").alias("value"),
    )
    fields = ("name", "utterance_count", "confidence", "is_guest", "is_unknown", "identified_by_llm")
    once = assigned.groupBy("video_id", "speaker").agg(
        F.max_by(F.struct(*fields), F.struct("utterance_count", "name")).alias("e"))
    return once.select("video_id", "speaker", "e.*").groupBy("video_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("speakers")
    )


def merge_speakers(episodes: DataFrame, maps: DataFrame) -> DataFrame:
    """Add new speakers to each episode's map; new entries win over stored ones.

    Also sets ``speaker_count`` of the episodes that got speakers.
    """
    new = maps.select("video_id", F.col("speakers").alias("_new"))
    merged = F.expr(
        "case when _new is null then metadata.speakers"
        " when metadata.speakers is null then _new"
        " else map_concat(map_filter(metadata.speakers,"
        " (k, v) -> not map_contains_key(_new, k)), _new) end"
    )
    return (
        episodes.join(new, "video_id", "left")
        .withColumn("metadata", F.col("metadata").withField("speakers", merged))
        .withColumn("speaker_count",
                    F.coalesce(F.when(F.col("_new").isNotNull(), F.size("_new")).cast("bigint"),
                               F.col("speaker_count")))
        .drop("_new")
    )
