"""Speaker turns over words, and the readable transcript built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.functions import transcripts as X
from talkgrain.plans import blocks

# The line under the header, and the text for an absent transcript.
RULE = "=" * 80
NO_DATA = "No transcript data found"

# The labels of the header lines.
TITLE, VIDEO, PUBLISHED = "# ", "Video ID: ", "Published: "
DURATION, TRANSCRIBED, COVERAGE = "Duration: ", "Transcript Duration: ", "Coverage: "


def speaker_turns(
    words: DataFrame,
    *,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Maximal runs of words by one speaker, one row each.

    Gives (video_id, block, turn_pos, speaker, start, words, text), where
    ``turn_pos`` is the position of the first word and ``block`` its block. An
    absent speaker is a value of its own. Row form, for recordings of any
    length; see :func:`turns_in_document`.

    Texts are joined within each block first, on the partitioning of the block
    windows; only those pieces are shuffled to build whole turns, and the result
    is partitioned on (video_id, block) for what follows.
    """
    rows = words.where("pos is not null").select(
        "video_id", "pos", "speaker",
        F.coalesce("start", F.lit(0.0)).alias("start"),
        X.word_text("punctuated_word", "word").alias("text"),
    )
    near = blocks.with_neighbours(
        rows, "video_id", "pos",
        previous={"_speaker": "speaker", "_pos": "pos"}, size=block_rows,
    ).withColumn("_starts", F.expr("_pos is null or not (speaker <=> _speaker)"))
    runs = blocks.with_run_start(near, "video_id", "pos", "_starts", name="turn_pos")
    pieces = runs.groupBy("video_id", "block", "turn_pos").agg(
        _joined("pos", "text").alias("text"),
        F.any_value("speaker").alias("speaker"),
        F.min_by("start", "pos").alias("start"),
        F.count("*").alias("words"),
    )
    return (
        pieces.withColumns({
            "piece": F.col("block"), "block": F.expr(f"turn_pos div {block_rows}"),
        })
        .repartition("video_id", "block")
        .groupBy("video_id", "block", "turn_pos")
        .agg(
            F.any_value("speaker").alias("speaker"),
            F.min_by("start", "piece").alias("start"),
            F.sum("words").alias("words"),
            _joined("piece", "text").alias("text"),
        )
    )


def _joined(order: str, text: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(ordered, lambda x: x[text]), " ")


def turns_in_document(transcripts: DataFrame) -> DataFrame:
    """The same turns straight from transcript documents, without any shuffle.

    Gives (video_id, turn_pos, speaker, start, words, text) for the words of the
    first alternative of the first channel. Also runs on a stream.
    """
    listed = "coalesce(get(get(results.channels, 0).alternatives, 0).words, array())"
    opens = ("filter(transform(ws, (w, i) -> if(i = 0 or not"
             " (w.speaker <=> get(ws, i - 1).speaker), i, null)), i -> i is not null)")
    turn = (
        "transform(at, (p, i) -> named_struct('turn_pos', cast(p as bigint),"
        " 'speaker', ws[p].speaker, 'start', coalesce(ws[p].start, 0D),"
        " 'ws', slice(ws, p + 1, coalesce(get(at, i + 1), size(ws)) - p)))"
    )
    return (
        transcripts.select(F.col("episode_metadata.video_id").alias("video_id"),
                           F.expr(listed).alias("ws"))
        .where("size(ws) > 0")
        .select("video_id", "ws", F.expr(opens).alias("at"))
        .select("video_id", F.explode(F.expr(turn)).alias("t"))
        .select(
            "video_id", "t.turn_pos", "t.speaker", "t.start",
            F.size("t.ws").cast("bigint").alias("words"),
            F.array_join(F.expr(
                "transform(t.ws, w -> coalesce(w.punctuated_word, w.word, ''))"), " ").alias("text"),
        )
    )


def names_by_video(speakers: DataFrame) -> DataFrame:
    """(video_id, names): speaker id to name, from a (video_id, speaker, name) table.

    A speaker listed more than once gets one of its names, the last in
    alphabetical order.
    """
    once = speakers.where("speaker is not null and name is not null").groupBy(
        "video_id", "speaker").agg(F.max("name").alias("name"))
    pairs = F.collect_list(F.struct("speaker", "name"))
    return once.groupBy("video_id").agg(F.map_from_entries(pairs).alias("names"))


def name_turns(
    turns: DataFrame,
    names: DataFrame,
    lengths: DataFrame,
    *,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Add ``name`` from :func:`names_by_video`, else ``Speaker <id>``.

    ``lengths`` (video_id, length) has the number of words of each transcript.
    """
    in_use = blocks.blocks_in_use(lengths, "video_id", size=block_rows)
    return blocks.attach_by_block(turns, names, in_use, "video_id").withColumn(
        "name", _name()).drop("names")


def _name() -> Column:
    named = F.expr("if(speaker is null, null, names[speaker])")
    return F.coalesce(named, X.speaker_tag("speaker"))


def header(episodes: DataFrame) -> DataFrame:
    """(video_id, header): the header lines of a readable transcript as an array."""
    timed = "coalesce(transcript_duration, 0) <> 0 and coalesce(metadata.duration_seconds, 0) <> 0"
    covered = f"{timed} and coalesce(metadata.transcript_coverage, 0) <> 0"
    lines = F.array(
        F.concat(F.lit(TITLE), "title"),
        F.concat(F.lit(VIDEO), "video_id"),
        F.concat(F.lit(PUBLISHED), F.date_format("published_at", "yyyy-MM-dd")),
        F.when(F.expr(timed), F.concat(
            F.lit(DURATION), F.coalesce("duration", F.lit("None")), F.lit(" ("),
            F.col("metadata.duration_seconds").cast("string"), F.lit(" seconds)"))),
        F.when(F.expr(timed), F.concat(
            F.lit(TRANSCRIBED), X.two_decimals("transcript_duration"),
            F.lit(" seconds"))),
        F.when(F.expr(covered), F.concat(
            F.lit(COVERAGE), F.col("metadata.transcript_coverage").cast("string"),
            F.lit("%"))),
        F.lit(""),
        F.lit(RULE),
        F.lit(""),
    )
    return episodes.select("video_id", F.array_compact(lines).alias("header"))


def header_lines(episodes: DataFrame) -> DataFrame:
    """The same as rows (video_id, line_no, line), line_no below 0."""
    numbered = header(episodes).select("video_id", F.posexplode("header").alias("i", "line"))
    return numbered.select("video_id", (F.col("i") - 100).cast("bigint").alias("line_no"), "line")


def readable_transcript(
    episodes: DataFrame,
    words: DataFrame,
    speakers: DataFrame,
    lengths: DataFrame | None = None,
    *,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Header and turn lines of each transcribed episode.

    Lines sort by (video_id, line_no). Episodes whose transcript has no words get
    the no-data line instead of turns; words of unknown episodes are left out.
    ``lengths`` (video_id, length) has the number of words where that is known.

    What an episode adds (header, names, whether it has words) is one row, which
    meets the turns once for each block of its words, and once more, as block -1,
    for the header. Turns keep the partitioning they were built on.
    """
    if lengths is None:
        lengths = blocks.lengths_of(words.where("pos is not null"), "video_id", "pos")
    transcribed = episodes.where("coalesce(transcript_filename, '') <> ''")
    facts = (
        header(transcribed).join(names_by_video(speakers), "video_id", "left")
        .join(lengths.select("video_id", "length"), "video_id", "left")
        .withColumn("length", F.coalesce("length", F.lit(0)))
        .withColumn("block", F.explode(F.expr(
            f"sequence(-1L, if(length > 0, (length - 1) div {block_rows}, -1L))")))
        .withColumns({
            "header": F.when(F.col("block") < 0, F.col("header")),
            "names": F.when(F.col("block") >= 0, F.col("names")),
        })
    )
    turns = speaker_turns(words, block_rows=block_rows)
    met = turns.join(facts, ["video_id", "block"], "right").withColumn("name", _name())

    def line(number: Column, text: Column) -> Column:
        return F.struct(number.cast("bigint").alias("line_no"), text.alias("line"))

    no_data = F.when(F.col("length") == 0, F.array(line(F.lit(0), F.lit(NO_DATA)))).otherwise(
        F.expr("cast(array() as array<struct<line_no: bigint, line: string>>)"))
    top = F.concat(F.transform("header", lambda x, i: line(i - 100, x)), no_data)
    turn = F.when(F.col("turn_pos").isNotNull(),
                  F.array(line(F.col("turn_pos"), X.turn_line("start", "name", "text"))))
    return met.select("video_id", F.inline(F.when(F.col("block") < 0, top).otherwise(turn)))
