"""Episode and transcript tables derived by Spark from the driver's parquet files.

``documents`` act as catalogue rows and ``conversations`` as transcripts: every
``conv_id`` is also a ``doc_id``. The derivations are specified in FIXTURES.md
and mirrored as DuckDB views in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.plans import blocks
from talkgrain.schemas import SPEAKER_ENTRY_DDL, UTTERANCE_DDL, WORD_DDL
from talkgrain.sources.catalogue import empty_metadata

# Turns per block when positions are counted along a conversation.
TURN_BLOCK = 1 << 13

# Turns whose documents one task writes, where there are more tasks than cores.
TURNS_PER_TASK = 2000

MS_PER_CHAR = 60

_LINES = "filter(split(text, '\\n'), l -> trim(l) <> '')"
_TOKENS = "filter(split({}, ' '), t -> t <> '')"
_SPEAKER = "case role when 'user' then 0 when 'assistant' then 1 when 'system' then 2 end"


# Columns of the driver's tables used here; stating them saves a footer scan per read.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
              " value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-blank line of a conversation, timed by its characters."""
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"),
        "conv_id",
        "turn",
        F.expr(_SPEAKER).alias("speaker"),
        F.expr(f"turn div {TURN_BLOCK}").alias("turn_block"),
        F.posexplode(F.expr(_LINES)).alias("line", "transcript"),
    )
    counted = blocks.with_running_totals(
        lines, "video_id", "turn_block", ("turn", "line"),
        {
            "pos": F.lit(1).cast("bigint"),
            "chars_before": F.length("transcript").cast("bigint"),
            "words_before": F.size(F.expr(_TOKENS.format("transcript"))).cast("bigint"),
        },
    )
    ms = MS_PER_CHAR
    return counted.select(
        "video_id",
        "pos",
        "speaker",
        "transcript",
        F.expr(f"chars_before * {ms} / 1000D").alias("start"),
        F.expr(f"(chars_before + length(transcript)) * {ms} / 1000D").alias("end"),
        F.expr("((conv_id * 31 + pos * 17) % 101) / 100D").alias("confidence"),
        F.expr("if(pos % 5 = 0, null, (pos * 7 % 10) / 10D)").alias("speaker_confidence"),
        "chars_before",
        "words_before",
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word; the words of a line share its time evenly."""
    tokens = F.expr(_TOKENS.format("transcript"))
    # Counted before the explode: what stands beside it is evaluated per word.
    lines = utterances(spark, sf_dir).select(
        "video_id",
        "words_before",
        F.expr("if(speaker = 2, null, speaker)").alias("speaker"),
        F.expr(f"chars_before * {MS_PER_CHAR}").alias("from_ms"),
        F.expr(f"length(transcript) * {MS_PER_CHAR}").alias("line_ms"),
        tokens.alias("tokens"),
    ).withColumn("n", F.size("tokens"))
    return lines.select(
        "video_id", "words_before", "speaker", "from_ms", "line_ms", "n",
        F.posexplode("tokens").alias("i", "token"),
    ).select(
        "video_id",
        F.expr("words_before + i").alias("pos"),
        "speaker",
        F.expr("(from_ms + line_ms * i div n) / 1000D").alias("start"),
        F.translate(F.lower("token"), ".,!?", "").alias("word"),
        F.expr("if((words_before + i) % 9 = 4, null, token)").alias("punctuated_word"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes_of(table(spark, sf_dir, "documents"))


def episodes_of(documents: DataFrame) -> DataFrame:
    """Catalogue rows as fetched, before any stage has run on them."""
    return documents.select(
        F.col("doc_id").cast("string").alias("video_id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("description"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(doc_id as int),0,0)")
        .alias("published_at"),
        F.col("source").alias("channel_id"),
        F.concat(F.lit("Channel "), "source").alias("channel_title"),
        F.expr("if(n_chars % 4 = 0, cast(array() as array<string>), array(lang))").alias("tags"),
        F.expr(
            "concat('PT', n_chars div 3600, 'H', n_chars % 3600 div 60, 'M', n_chars % 60, 'S')"
        ).alias("duration"),
        F.expr("n_chars * 10").alias("view_count"),
        F.expr("if(doc_id % 7 = 0, null, n_chars)").alias("like_count"),
        F.expr("if(doc_id % 11 = 0, null, doc_id % 97)").alias("comment_count"),
        F.concat(F.lit("https://img.example/"), "doc_id", F.lit(".jpg")).alias("thumbnail_url"),
        F.expr("case doc_id % 3 when 0 then concat(doc_id, '.webm') when 1 then '' end")
        .alias("webm_filename"),
        F.expr("if(doc_id % 5 = 0, null, concat(doc_id, '.mp3'))").alias("audio_filename"),
        F.lit(None).cast("string").alias("transcript_filename"),
        F.lit(None).cast("double").alias("transcript_duration"),
        F.lit(None).cast("bigint").alias("transcript_utterances"),
        F.lit(None).cast("bigint").alias("speaker_count"),
        empty_metadata().alias("metadata"),
    )


def transcript_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, seconds and lines per role of each conversation, in one aggregation."""
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), "role", F.expr(_LINES).alias("lines")
    ).withColumns({
        "n": F.expr("cast(size(lines) as bigint)"),
        "chars": F.expr("aggregate(lines, 0L, (a, l) -> a + length(l))"),
        "words": F.expr(f"aggregate(lines, 0L, (a, l) -> a + size({_TOKENS.format('l')}))"),
    })
    return lines.groupBy("video_id").agg(
        F.sum("n").alias("n_lines"),
        F.sum("chars").alias("n_line_chars"),
        F.sum("words").alias("n_words"),
        *[F.sum(F.when(F.col("role") == r, F.col("n")).otherwise(0)).alias(f"n_{r}")
          for r in ("user", "assistant", "system")],
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows with the transcript columns of the episodes that have one.

    Conversations with a system turn already have speakers stored: one unknown
    speaker per role.
    """
    entries = ", ".join(
        f"if(n_{role} > 0, struct('{i}', struct('Unknown Speaker {i}' as name,"
        f" n_{role} as utterance_count, 0.1D as confidence, false as is_guest,"
        " true as is_unknown, false as identified_by_llm)), null)"
        for i, role in enumerate(("user", "assistant", "system"))
    )
    stored = F.expr(
        f"if(n_system > 0, cast(map_from_entries(array_compact(array({entries})))"
        f" as map<string, {SPEAKER_ENTRY_DDL}>), null)"
    )
    facts = transcript_facts(spark, sf_dir)
    return (
        episodes(spark, sf_dir).join(facts, "video_id", "left")
        .withColumns({
            "transcript_filename": F.expr("if(n_lines is null, null, concat(video_id, '.json'))"),
            "transcript_duration": F.expr(f"n_line_chars * {MS_PER_CHAR} / 1000D"),
            "transcript_utterances": F.col("n_lines"),
            "metadata": F.col("metadata").withField("speakers", stored),
        })
        .drop("n_lines", "n_line_chars", "n_words", "n_user", "n_assistant", "n_system")
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on storage: audio of labelled documents, transcripts of answered talks."""
    audio = table(spark, sf_dir, "labels").select(
        F.concat("doc_id", F.lit(".mp3")).alias("file_name")
    )
    transcripts = (
        table(spark, sf_dir, "conversations").where("role = 'assistant'")
        .select(F.concat("conv_id", F.lit(".json")).alias("file_name")).distinct()
    )
    return audio.unionByName(transcripts)


def stored_with_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).withColumn("ordinal", F.col("video_id").cast("bigint"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetched batch: labelled documents retitled, and each benchmark item twice."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("video_id"), F.col("doc_id").alias("ordinal"),
        F.coalesce("quality", F.lit(0)).alias("quality"),
    )
    known = episodes(spark, sf_dir).join(labels, "video_id").withColumn(
        "title", F.concat(F.lit("Updated "), "quality", F.lit(": "), "title")
    ).drop("quality")
    fetched = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("new-"), "item_id").alias("video_id"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("take"),
        "item_id", "text",
    ).select(
        "video_id",
        F.concat(F.lit("Take "), "take", F.lit(": "), F.substring("text", 1, 40)).alias("title"),
        F.col("text").alias("description"),
        F.expr("timestamp'2025-01-01 00:00:00'"
               " + make_interval(0,0,0,0,cast(item_id as int),0,0)").alias("published_at"),
        F.lit("bench").alias("channel_id"),
        F.lit("Channel bench").alias("channel_title"),
        F.expr("cast(array() as array<string>)").alias("tags"),
        F.expr("concat('PT', length(text), 'S')").alias("duration"),
        F.expr("cast(length(text) as bigint)").alias("view_count"),
        F.lit(None).cast("bigint").alias("like_count"),
        F.lit(None).cast("bigint").alias("comment_count"),
        *[F.lit(None).cast("string").alias(c) for c in
          ("thumbnail_url", "webm_filename", "audio_filename", "transcript_filename")],
        F.lit(None).cast("double").alias("transcript_duration"),
        F.lit(None).cast("bigint").alias("transcript_utterances"),
        F.lit(None).cast("bigint").alias("speaker_count"),
        empty_metadata().alias("metadata"),
        F.expr("item_id * 10 + take").alias("ordinal"),
    )
    return known.unionByName(fetched)


def document_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows for the transcript documents, one per turn."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), "turn")
    return episodes(spark, sf_dir).join(turns, "video_id").withColumn(
        "video_id", F.concat("video_id", F.lit("-"), "turn")).drop("turn")


def video_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as landed video-API items (JSON text); some statistics are absent."""
    item = F.expr("""
        to_json(named_struct(
          'id', cast(doc_id as string),
          'snippet', named_struct(
            'title', substring(text, 1, 60), 'description', text,
            'publishedAt', date_format(timestamp'2024-01-01 00:00:00'
              + make_interval(0,0,0,0,cast(doc_id as int),0,0), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            'channelId', source, 'channelTitle', concat('Channel ', source),
            'tags', if(n_chars % 4 = 0, null, array(lang)),
            'thumbnails', named_struct('high', named_struct(
              'url', concat('https://img.example/', doc_id, '.jpg'))),
            'resourceId', named_struct('videoId', concat('v', doc_id))),
          'contentDetails', named_struct('duration', concat('PT', n_chars, 'S')),
          'statistics', named_struct(
            'viewCount', if(doc_id % 13 = 0, null, cast(n_chars * 10 as string)),
            'likeCount', if(doc_id % 7 = 0, null, cast(n_chars as string)),
            'commentCount', if(doc_id % 11 = 0, null, cast(doc_id % 97 as string)))))
    """)
    # Some items arrive a second time, cut short, and some with an empty count.
    again = "if(doc_id % 10 = 3, array('whole', 'cut', 'uncounted'), array('whole'))"
    landed = table(spark, sf_dir, "documents").withColumn("form", F.explode(F.expr(again)))
    return landed.withColumn("item", item).select(F.expr(
        "case form when 'cut' then left(item, length(item) - 2) when 'uncounted' then"
        " concat('{\"id\": \"', doc_id, 'u\", \"statistics\": {\"viewCount\": \"\", \"likeCount\": \"many\"}}')"
        " else item end").alias("item"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per conversation, in the forms answers take (or null)."""
    convs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return convs.select(
        F.col("conv_id").cast("string").alias("video_id"),
        F.expr("""
            case conv_id % 5
              when 0 then concat('{"hosts": [{"name": "Host A', conv_id % 3,
                '", "confidence": 0.9}, {"name": "Host B"}], "guests": []}')
              when 1 then concat('{"hosts": [{"name": "Host A", "confidence": 0.6},',
                ' {"name": "", "confidence": 0.5}, {"name": "Host A", "confidence": 0.95}],',
                ' "guests": [{"name": "Guest ', conv_id % 7, '"}, {"name": "Guest Z",',
                ' "confidence": 0.65, "mentioned_in": ["title"]}]}')
              when 2 then concat('Here you are:\\n{"guests": [{"name": "Guest ', conv_id % 7,
                '", "confidence": 0.75}]}\\nHope this helps.')
              when 3 then 'I cannot tell who is speaking.'
            end
        """).alias("response"),
    )


def spread_turns(conversations: DataFrame) -> DataFrame:
    """Conversation turns spread over tasks before documents, which are many times larger, are built of them:
    a table that lies in one small file would be one task. Turns of one document name stay in one task."""
    cores = conversations.sparkSession.sparkContext.defaultParallelism
    tasks = max(3 * cores, conversations.count() // TURNS_PER_TASK)
    return by_document(conversations, tasks)


def by_document(conversations: DataFrame, tasks: int) -> DataFrame:
    return conversations.repartition(tasks, F.expr("concat(conv_id, '-', turn)"))


def transcript_documents(spark: SparkSession, sf_dir: str, *, stamped: bool = True) -> DataFrame:
    return documents_of(table(spark, sf_dir, "conversations"), stamped=stamped)


def documents_of(conversations: DataFrame, *, stamped: bool = True) -> DataFrame:
    """Each conversation turn as one landed transcript document (JSON text), and beside those of
    system turns a broken, a bare and an undated upload of the same.

    A turn fits a row, so a document is built without gathering a conversation. Not ``stamped``:
    documents of odd turns have no episode metadata.
    """
    utterance = (
        "named_struct('transcript', l, 'start', i * 5D, 'end', i * 5D + 4.5D,"
        f" 'speaker', cast({_SPEAKER} as int),"
        " 'speaker_confidence', if(i % 3 = 0, null, 0.5D),"
        " 'confidence', ((conv_id * 31 + i * 17) % 101) / 100D)"
    )
    word = (
        "named_struct('word', lower(w), 'punctuated_word', if(j % 9 = 4, null, w),"
        f" 'start', j * 0.5D, 'speaker', if(j div 6 % 3 = 2, null, cast({_SPEAKER} as int) + j div 6 % 3))"
    )
    has_stamp = "form <> 'bare'" if stamped else "form <> 'bare' and turn % 2 = 0"
    document = f"""
        to_json(named_struct(
          'results', named_struct(
            'duration', size(lines) * 5D,
            'transcript', text,
            'utterances', cast(transform(lines, (l, i) -> {utterance}) as array<{UTTERANCE_DDL}>),
            'channels', array(named_struct('alternatives', array(named_struct(
              'words', cast(transform({_TOKENS.format("translate(text, '\n', ' ')")},
                (w, j) -> {word}) as array<{WORD_DDL}>)))))),
          'episode_metadata', if({has_stamp}, named_struct(
            'video_id', concat(conv_id, '-', turn), 'title', concat('Part ', turn),
            'published_at', if(form = 'undated', 'some day', date_format(timestamp'2024-01-01 00:00:00'
              + make_interval(0,0,0,0,cast(conv_id as int),0,0), "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
            null)))
    """
    forms = "if(role = 'system', array('whole', 'broken', 'bare', 'undated'), array('whole'))"
    built = conversations.withColumn("lines", F.expr(_LINES)).withColumn(
        "form", F.explode(F.expr(forms))).withColumn("_d", F.expr(document))
    return built.select(
        F.expr("concat(conv_id, '-', turn, if(form = 'whole', '', concat('-', form)), '.json')")
        .alias("file_name"),
        F.expr("left(_d, length(_d) - if(form = 'broken', 3, 0))").alias("document"),
    )


def long_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations end to end as three long recordings."""
    lines = table(spark, sf_dir, "conversations").select(
        F.expr("concat('long-', conv_id % 3)").alias("video_id"),
        "conv_id", "turn", F.expr(_SPEAKER).alias("speaker"),
        F.expr("conv_id div 64").alias("stretch"),
        F.posexplode(F.expr(_LINES)).alias("line", "transcript"),
    )
    counted = blocks.with_running_totals(
        lines, "video_id", "stretch", ("conv_id", "turn", "line"), {"pos": F.lit(1).cast("bigint")})
    return counted.select(
        "video_id", "pos", "speaker", "transcript",
        F.expr("pos * 2D").alias("start"), F.expr("pos * 2D + 1.5D").alias("end"),
        F.expr("(pos * 17 % 101) / 100D").alias("confidence"),
        F.expr("if(pos % 5 = 0, null, (pos * 7 % 10) / 10D)").alias("speaker_confidence"),
    )


def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the long recordings as words of their own."""
    return long_utterances(spark, sf_dir).select(
        "video_id", "pos", F.expr("if(speaker = 2, null, speaker)").alias("speaker"), "start",
        F.col("transcript").alias("word"), F.lit(None).cast("string").alias("punctuated_word"))
