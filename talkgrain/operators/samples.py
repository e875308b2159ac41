"""Samples of a transcript, the conversation they show, and prompts made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import episodes as E
from talkgrain.functions import transcripts as X

# Sizes of a sample, and the headers of its sections.
SAMPLE_CHARS = 4000
SECTION_UTTERANCES = 20
PLAIN_LINES = 10
HEAD_UTTERANCES = 10
BEGINNING = "--- BEGINNING OF TRANSCRIPT ---"
MIDDLE = "--- MIDDLE OF TRANSCRIPT ---"
END = "--- END OF TRANSCRIPT ---"


def transcript_sample(
    utterances: DataFrame,
    transcripts: DataFrame | None = None,
    max_chars: int = SAMPLE_CHARS,
    section_size: int = SECTION_UTTERANCES,
) -> DataFrame:
    """(video_id, sample): the start, middle and end of each transcript.

    Each section has up to ``section_size`` utterances and stops after the line
    that takes it past a third of ``max_chars``; a section is left out, header
    included, once the sample is full. ``transcripts`` (video_id) adds those
    without any utterance.

    Sections name the positions they need, at most ``3 * section_size`` per
    transcript, and meet the utterances on (video_id, pos): the long table is
    never gathered by video.
    """
    counts = utterances.groupBy("video_id").agg(F.count("*").alias("n"))
    if transcripts is not None:
        counts = (
            transcripts.select("video_id").join(counts, "video_id", "left")
            .withColumn("n", F.coalesce("n", F.lit(0)))
        )
    k = section_size
    sections = counts.select("video_id", "n", F.inline(F.expr(
        "array("
        f" named_struct('section', 1, 'first', 0L, 'size', least({k}, n)),"
        f" named_struct('section', 2, 'first', n div 2, 'size', least({k}, n div 2)),"
        f" named_struct('section', 3, 'first', greatest(0L, n - {k}), 'size', least({k}, n)))"
    ))).withColumn(
        "header",
        F.expr(f"case when first = 0 then '{BEGINNING}' when first = n div 2 then '{MIDDLE}'"
               f" else '{END}' end"),
    )
    headers = sections.select(
        "video_id", "section", F.lit(-1).cast("bigint").alias("pos"),
        F.col("header").alias("line"), F.lit(0).alias("chars"),
    )
    wanted = sections.where("size > 0").select(
        "video_id", "section", F.explode(F.expr("sequence(first, first + size - 1)")).alias("pos")
    )
    spoken = utterances.where("speaker is not null and transcript is not null").select(
        "video_id", "pos",
        F.concat(X.speaker_tag("speaker"), F.lit(": "), "transcript").alias("line"),
    ).withColumn("chars", F.length("line"))
    lines = headers.unionByName(
        spoken.join(wanted, ["video_id", "pos"]).select(*headers.columns)
    )
    so_far = Window.partitionBy("video_id", "section").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, -1
    )
    kept = lines.withColumn("_used", F.coalesce(F.sum("chars").over(so_far), F.lit(0))).where(
        F.col("_used") * 3 <= max_chars
    )
    per_section = kept.groupBy("video_id", "section").agg(
        F.sum("chars").alias("chars"),
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("section", "chars", "lines")))
    joined = F.expr(
        "array_join(transform(flatten(transform(filter(s, (x, i) ->"
        " aggregate(slice(s, 1, i), 0L, (a, y) -> a + y.chars)"
        f" < {max_chars}), x -> x.lines)), x -> x.line), '\\n')"
    )
    return per_section.groupBy("video_id").agg(ordered.alias("s")).select(
        "video_id", joined.alias("sample")
    )


def sample_in_document(
    transcripts: DataFrame, max_chars: int = SAMPLE_CHARS, section_size: int = SECTION_UTTERANCES
) -> DataFrame:
    """The same sample straight from transcript documents, without a shuffle.

    A document that has no list of utterances at all is sampled from its plain
    text by :func:`plain_sample`.
    """
    k = section_size
    stretches = (("0", f"least({k}, n)"), ("n div 2", f"least({k}, n div 2)"),
                 (f"greatest(0, n - {k})", f"least({k}, n)"))
    line = "concat('Speaker ', cast(u.speaker as string), ': ', u.transcript)"
    said = ("transform(filter(slice(us, {0} + 1, {1}), u -> u.speaker is not null"
            " and u.transcript is not null), u -> " + line + ")")
    fits = ("filter({0}, (l, i) -> 3 * aggregate(slice({0}, 1, i), 0, (a, x) -> a + length(x))"
            f" <= {max_chars})")
    header = (f"case when {{0}} = 0 then '{BEGINNING}' when {{0}} = n div 2 then '{MIDDLE}'"
              f" else '{END}' end")
    rows = transcripts.select(
        F.col("episode_metadata.video_id").alias("video_id"), "results.utterances",
        F.col("results.transcript").alias("plain"),
        F.expr("coalesce(results.utterances, array())").alias("us"),
    ).withColumn("n", F.size("us"))
    rows = rows.withColumns({f"s{i}": F.expr(said.format(*s)) for i, s in enumerate(stretches)})
    sections = ", ".join(
        f"named_struct('h', {header.format(first)}, 'ls', {fits.format(f's{i}')})"
        for i, (first, _) in enumerate(stretches))
    kept = ("filter(sections, (s, i) -> aggregate(slice(sections, 1, i), 0, (a, x) ->"
            f" a + aggregate(x.ls, 0, (b, l) -> b + length(l))) < {max_chars})")
    rows = rows.withColumn("sections", F.expr(f"array({sections})"))
    spoken = F.expr(f"array_join(flatten(transform({kept}, s -> concat(array(s.h), s.ls))), '\\n')")
    return rows.select("video_id", F.when(F.col("utterances").isNotNull(), spoken).otherwise(
        plain_sample(F.coalesce("plain", F.lit("")))).alias("sample"))


def plain_sample(text: Column | str, lines: int = PLAIN_LINES) -> Column:
    """Sample of a plain transcript: all lines, or ten from start, middle and end."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(t, "\n")
    n = F.size(parts)
    middle = F.floor(n / 2).cast("int") - lines // 2 + 1
    some = F.concat(
        F.array(F.lit(BEGINNING)), F.slice(parts, 1, lines),
        F.array(F.lit(MIDDLE)), F.slice(parts, middle, F.lit(lines)),
        F.array(F.lit(END)), F.slice(parts, -lines, lines),
    )
    return F.array_join(F.when(n > 3 * lines, some).otherwise(parts), "\n")


def head_sample(transcripts: DataFrame, size: int = HEAD_UTTERANCES) -> DataFrame:
    """(video_id, sample): the first utterances of each transcript document."""
    line = (
        f"transform(slice(results.utterances, 1, {size}), u -> concat('Speaker ',"
        " coalesce(cast(u.speaker as string), '?'), ': ', coalesce(u.transcript, '')))"
    )
    return transcripts.select(
        F.col("episode_metadata.video_id").alias("video_id"),
        F.coalesce(F.array_join(F.expr(line), "\n"), F.lit("")).alias("sample"),
    )


def conversation_turns(samples: DataFrame) -> DataFrame:
    """(video_id, turn, speaker, text) from sample lines.

    A line beginning with ``Speaker `` opens a turn, up to its first colon; other
    lines continue it; lines before the first such line and empty turns drop out.
    Samples are short, so each is regrouped inside its own row.
    """
    turns = F.expr(r"""
        aggregate(
          split(sample, '\n'),
          cast(array() as array<struct<speaker: string, text: string>>),
          (acc, line) -> case
            when startswith(line, 'Speaker ') then array_append(acc, named_struct(
              'speaker', get(split(line, ':', 2), 0),
              'text', btrim(coalesce(get(split(line, ':', 2), 1), ''), ' \t\r\n')))
            when size(acc) = 0 then acc
            else array_append(slice(acc, 1, size(acc) - 1), named_struct(
              'speaker', element_at(acc, -1).speaker,
              'text', concat(element_at(acc, -1).text, ' ', btrim(line, ' \t\r\n'))))
          end,
          acc -> filter(acc, t -> t.text <> ''))
    """)
    return samples.select("video_id", F.posexplode(turns).alias("turn", "t")).select(
        "video_id", F.col("turn").cast("bigint").alias("turn"), "t.speaker", "t.text"
    )


def conversation_text(turns: DataFrame) -> DataFrame:
    """(video_id, conversation): the turns of each sample, one line each."""
    line = F.concat("speaker", F.lit(": "), "text")
    ordered = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return turns.groupBy("video_id").agg(text.alias("conversation"))


def speaker_prompts(
    episodes: DataFrame, conversations: DataFrame, hosts: Sequence[tuple[str, str]]
) -> DataFrame:
    """(video_id, prompt): the question a language model is asked about each episode.

    ``episodes`` are those to ask about; one whose sample shows no conversation is
    asked about all the same. ``hosts`` lists (name, speaking style). Answering is outside the library;
    answers come back as a table, see ``operators.speakers``.
    """
    names = "\n".join(f"{i}. {name}" for i, (name, _) in enumerate(hosts, 1))
    styles = "\n".join(f"- {name}: {style}" for name, style in hosts if style)
    people = f"Regular hosts:\n{names}" + (f"\nHow they speak:\n{styles}" if styles else "")
    asked = (
        "Say which of these hosts take part, which guests appear, and who each numbered"
        " speaker is.\nAnswer with one JSON object of this form:\n"
        '{"hosts": [{"name": "...", "confidence": 0.9, "mentioned_in": ["title"]}],'
        ' "guests": [{"name": "...", "confidence": 0.8, "mentioned_in": ["description"]}]}'
    )
    hint = E.guest_hint("description")
    prompt = F.concat_ws(
        "\n\n",
        F.lit("Name the speakers of this recorded episode."),
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Description: "), F.coalesce("description", F.lit(""))),
        F.concat(F.lit("Announced guest (after \""), F.btrim(hint["phrase"]), F.lit("\"): "), hint["name"]),
        F.concat(F.lit("Transcript:\n"), F.coalesce("conversation", F.lit(""))),
        F.lit(people),
        F.lit(asked),
    )
    return episodes.join(conversations, "video_id", "left").select(
        "video_id", prompt.alias("prompt"))
