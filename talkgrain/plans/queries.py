"""The registered queries: each operator run over the driver's whole tables.

Results are flat (nested values are spread into columns, lists are joined), so
that they compare with the SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.functions import episodes as E
from talkgrain.functions import transcripts as X
from talkgrain.operators import catalogue as C
from talkgrain.operators import chunks as K
from talkgrain.operators import fulltext as FT
from talkgrain.operators import report as R
from talkgrain.operators import search as Q
from talkgrain.operators import samples as S
from talkgrain.operators import speakers as P
from talkgrain.operators import topics as TP
from talkgrain.operators import turns as U
from talkgrain.operators import usage as G
from talkgrain.operators import vectors as V
from talkgrain.plans import tables as T
from talkgrain.plans.scratch import scratch_dir, stored
from talkgrain.sources import catalogue as SC
from talkgrain.sources import documents as SD
from talkgrain.sources import transcripts as ST
from talkgrain.sources.folders import write_folders
from talkgrain.sources.listing import read_by_cores
from talkgrain.streaming import incremental as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOSTS = (("Alex Moreau", "asks the questions"), ("Dana Whitfield", "explains at length"))
IDS = " 3, 17,,99999999 , 42"


def query(run: Query) -> Query:
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return run(spark, sf_dir)

    QUERIES[run.__name__] = in_utc
    return run


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(T.catalogue(spark, d))


def _lengths(spark: SparkSession, d: str, column: str) -> DataFrame:
    return T.transcript_facts(spark, d).select("video_id", F.col(column).alias("length"))


def _flat_chunks(documents: DataFrame) -> DataFrame:
    return documents.select(
        "chunk_id", "video_id", "chunk_index", "content", "start_time", "end_time", "duration",
        "speaker_id", "speaker_confidence", "confidence_score", "episode_title", "published_at",
        "episode_type", "episode_duration",
        "episode_description", "timestamp",
        F.array_join("tags", ",").alias("tags"),
        F.col("statistics.view_count").alias("view_count"),
        F.col("statistics.like_count").alias("like_count"),
        F.col("statistics.comment_count").alias("comment_count"),
        F.col("metadata.duration_seconds").alias("metadata_seconds"),
        F.col("metadata.episode_type").alias("metadata_type"),
        F.col("metadata.engagement_metrics.views").alias("views"),
        F.col("metadata.engagement_metrics.likes").alias("likes"),
        F.col("metadata.engagement_metrics.comments").alias("comments"),
        F.col("context.previous").alias("previous"),
        F.col("context.next").alias("next"),
        F.col("metadata.year").alias("year"),
        F.col("metadata.month").alias("month"),
        F.col("metadata.day").alias("day"),
        F.col("metadata.confidence_tier").alias("confidence_tier"),
        F.col("metadata.has_tags").alias("has_tags"),
    )


def _flat_episodes(rows: DataFrame) -> DataFrame:
    return rows.select(
        "video_id", "title", "description", SC.iso_text("published_at").alias("published_at"),
        "channel_id", "channel_title",
        F.array_join("tags", ",").alias("tags"), "duration", "view_count", "like_count",
        "comment_count", "thumbnail_url", "webm_filename", "audio_filename", "transcript_filename",
        "transcript_duration", "transcript_utterances", "speaker_count",
        F.col("metadata.type").alias("type"),
        F.col("metadata.duration_seconds").alias("duration_seconds"),
        F.col("metadata.transcript_coverage").alias("coverage"),
        F.expr("array_join(array_sort(map_keys(metadata.speakers)), ',')").alias("speaker_ids"),
    )


# -- sources and sinks -------------------------------------------------------

def _catalogue_documents(spark: SparkSession, d: str) -> str:
    """Where the catalogue is written as documents ``{"episodes": [...]}`` of a few hundred rows, and a
    broken one beside them."""
    path = scratch_dir(spark, "catalogue")
    rows = T.catalogue(spark, d).withColumn("published_at", SC.iso_text("published_at"))
    documents = rows.withColumn("part", F.expr("cast(video_id as bigint) div 500")).groupBy("part").agg(
        F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias("episodes"))).alias("value"))
    broken = documents.where("part = 0").select(
        F.lit(-1).cast("bigint").alias("part"), F.expr("left(value, length(value) - 2)").alias("value"))
    documents.unionByName(broken).repartition("part").write.partitionBy("part").text(path)
    return f"{path}/*/"


@query
def scan_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Read back all documents of the catalogue."""
    return _flat_episodes(SC.read_catalogue(spark, _catalogue_documents(spark, d)))


@query
def scan_catalogue_documents(spark: SparkSession, d: str) -> DataFrame:
    """Read back all documents of the catalogue by the reader that splits a document."""
    return _flat_episodes(SD.read_large_catalogue(spark, _catalogue_documents(spark, d)))


@query
def scan_catalogue_lines(spark: SparkSession, d: str) -> DataFrame:
    """Write the catalogue as JSON lines, some of them cut short once more, and read it back."""
    path = scratch_dir(spark, "catalogue-lines")
    rows = T.stored_with_ordinal(spark, d).withColumn("published_at", SC.iso_text("published_at"))
    line = F.to_json(F.struct(*rows.columns))
    forms = F.explode(F.expr("if(ordinal % 10 = 3, array('whole', 'cut'), array('whole'))"))
    rows.select(line.alias("line"), forms.alias("form")).select(F.expr(
        "if(form = 'cut', left(line, length(line) - 2), line)").alias("value")).write.text(path)
    return _flat_episodes(SC.read_catalogue_lines(spark, path))


@query
def catalogue_version(spark: SparkSession, d: str) -> DataFrame:
    """Write the classified catalogue as a new parquet version, read it back."""
    path = scratch_dir(spark, "catalogue-version")
    SC.write_catalogue(_classified(spark, d), path)
    return _flat_episodes(spark.read.parquet(path))


@query
def dedup_catalogue_last(spark: SparkSession, d: str) -> DataFrame:
    stacked = T.stored_with_ordinal(spark, d).unionByName(
        T.updates(spark, d).withColumn("ordinal", F.col("ordinal") + 10**9)
    )
    return _flat_episodes(C.dedup_catalogue(stacked))


def _parsed(spark: SparkSession, d: str, *, stamped: bool = True) -> DataFrame:
    return ST.parse_transcripts(T.transcript_documents(spark, d, stamped=stamped))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents that parse, of all turns; bare and undated uploads are other queries' matter."""
    return ST.accepted(_parsed(spark, d)).where(f"not ({K.UNSTAMPED} or {K.UNDATED})")


@query
def scan_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select(
        "file_name",
        F.col("_corrupt_record").isNotNull().alias("rejected"),
        F.col("results.duration").alias("duration"),
        F.col("episode_metadata.video_id").alias("video_id"),
        F.expr("cast(size(results.utterances) as bigint)").alias("utterances"),
    )


def _landed(spark: SparkSession, d: str, name: str) -> str:
    """Transcript documents as files, each in a folder named after it; these lie in 256 others."""
    path = scratch_dir(spark, name)
    turns = T.spread_turns(T.table(spark, d, "conversations"))
    rows = T.documents_of(turns).withColumn("shelf", F.expr("pmod(hash(file_name), 256)"))
    write_folders(rows, path, ("shelf", "file_name"), "document")
    return path


@query
def transcript_files(spark: SparkSession, d: str) -> DataFrame:
    """The same facts from documents that lie as files, broken ones among them."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), "file_name=([^/]*)/", 1)
    files = ST.read_transcripts(spark, _landed(spark, d, "transcripts"), names="part-*", deep=True)
    facts = files.select(
        folder.alias("file_name"),
        F.col("_corrupt_record").isNotNull().alias("rejected"),
        F.col("results.duration").alias("duration"),
        F.col("episode_metadata.video_id").alias("video_id"),
        F.expr("cast(size(results.utterances) as bigint)").alias("utterances"),
    )
    with read_by_cores(spark):
        return stored(facts, "transcript-facts")


@query
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Number of the landed transcript files by the first digit of their folder, and whether all of
    them have contents."""
    listed = SC.read_inventory(spark, _landed(spark, d, "inventory"))
    return listed.where("file_name like 'part-%'").groupBy(
        F.regexp_extract("path", "file_name=([0-9])", 1).alias("digit")).agg(
        F.count("*").alias("files"), (F.min("length") > 1).alias("filled"))


@query
def rejected_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return I.rejected_stream(T.transcript_documents(spark, d))


@query
def explode_utterances(spark: SparkSession, d: str) -> DataFrame:
    return ST.utterances(ST.accepted(_parsed(spark, d)))


@query
def explode_words(spark: SparkSession, d: str) -> DataFrame:
    return ST.words(ST.accepted(_parsed(spark, d)))


@query
def flatten_video_items(spark: SparkSession, d: str) -> DataFrame:
    """Landed items as files of one JSON object per line, some of them broken."""
    path = scratch_dir(spark, "items")
    T.video_items(spark, d).withColumnRenamed("item", "value").write.text(path)
    return _flat_episodes(SC.episodes_from_items(SC.read_video_items(spark, path)))


@query
def playlist_video_ids(spark: SparkSession, d: str) -> DataFrame:
    return SC.playlist_video_ids(SC.parse_video_items(T.video_items(spark, d)))


@query
def transcript_to_json(spark: SparkSession, d: str) -> DataFrame:
    """Export accepted transcripts as JSON and read the export back."""
    exported = ST.as_json(ST.accepted(_parsed(spark, d)))
    again = ST.parse_transcripts(exported)
    return again.select(
        "file_name",
        F.col("results.transcript").alias("transcript"),
        F.expr("array_join(transform(results.utterances, u -> u.transcript), '|')")
        .alias("utterances"),
    )


@query
def transcript_to_json_whole(spark: SparkSession, d: str) -> DataFrame:
    """Stamp transcripts that have keys beyond the schema, export them, and read those keys back."""
    landed = T.transcript_documents(spark, d, stamped=False).withColumn("document", F.replace(
        "document", F.lit('"results":{'), F.lit('"origin":{"model":"m-2","tags":["a",null,1.5]},"results":{"summary":"in short",')))
    parsed = ST.accepted(ST.parse_transcripts(landed, whole=True)).withColumn(
        "video_id", F.regexp_replace("file_name", "-.*$", ""))
    exported = ST.as_json(ST.attach_episode_metadata(parsed, _classified(spark, d)))
    whole = exported.select("file_name", "document", F.parse_json("document").alias("v"))
    return whole.select(
        "file_name", *(F.variant_get("v", path, "string").alias(name) for name, path in (
            ("model", "$.origin.model"), ("tag", "$.origin.tags[2]"), ("summary", "$.results.summary"),
            ("stamped_id", "$.episode_metadata.video_id"))),
        F.get_json_object("document", "$.results.transcript").alias("transcript"))


@query
def names_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Which episode each transcript belongs to: the one that names its file, else the one it states."""
    episodes = T.catalogue(spark, d).select(
        F.col("video_id"), F.regexp_replace("transcript_filename", "\\.json$", "-1.json").alias("transcript_filename"))
    return ST.name_by_file(ST.accepted(_parsed(spark, d, stamped=False)), episodes).select("file_name", "video_id")


@query
def upsert_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Upsert into a base that has every fifth video twice."""
    base = T.stored_with_ordinal(spark, d)
    twice = base.where("cast(video_id as bigint) % 5 = 0").withColumns(
        {"ordinal": F.col("ordinal") + 10**6, "title": F.concat(F.lit("Later "), "title")})
    return _flat_episodes(C.upsert(base.unionByName(twice), T.updates(spark, d)))


@query
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Write chunk documents one directory per month, read them back."""
    path = scratch_dir(spark, "chunks")
    ST.write_chunks(K.chunk_documents(_enriched(spark, d)), path)
    return _flat_chunks(ST.read_chunks(spark, path))


@query
def readable_files(spark: SparkSession, d: str) -> DataFrame:
    """Write readable transcripts one directory per video, read the lines back."""
    path = scratch_dir(spark, "readable")
    ST.write_readable(_readable(spark, d), path)
    with read_by_cores(spark):
        return stored(ST.read_readable(spark, path).select("video_id", "line"), "readable-lines")


# -- catalogue ---------------------------------------------------------------

@query
def episode_by_id(spark: SparkSession, d: str) -> DataFrame:
    return C.episode_by_id(T.episodes(spark, d), "17").select("video_id", "title", "duration")


@query
def episodes_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.episodes_by_ids(T.episodes(spark, d), IDS).select("video_id", "title", "duration")


@query
def search_episodes(spark: SparkSession, d: str) -> DataFrame:
    return C.search_episodes(T.episodes(spark, d), "This IN").select("video_id", "title")


@query
def parse_duration(spark: SparkSession, d: str) -> DataFrame:
    return T.episodes(spark, d).select(
        "video_id", "duration", E.duration_seconds("duration").alias("duration_seconds")
    )


@query
def classify_episodes(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(T.episodes(spark, d)).select(
        "video_id", "metadata.duration_seconds", "metadata.type"
    )


@query
def full_episode_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.of_type(C.classify(T.episodes(spark, d))).select("video_id")


@query
def latest_episodes(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(T.episodes(spark, d), 10).select(
        "video_id", SC.iso_text("published_at").alias("published_at")
    )


@query
def latest_full_episodes(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(C.of_type(C.classify(T.episodes(spark, d))), 5).select("video_id")


@query
def type_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.type_summary(C.classify(T.episodes(spark, d)))


@query
def episode_listing(spark: SparkSession, d: str) -> DataFrame:
    return C.listing(C.classify(T.episodes(spark, d)))


@query
def needs_download(spark: SparkSession, d: str) -> DataFrame:
    return C.needs_download(C.classify(T.episodes(spark, d))).select("video_id", "duration")


@query
def needs_convert(spark: SparkSession, d: str) -> DataFrame:
    return C.needs_convert(T.episodes(spark, d)).select("video_id", "webm_filename")


@query
def needs_transcribe(spark: SparkSession, d: str) -> DataFrame:
    return C.needs_transcribe(T.episodes(spark, d)).select("video_id", "audio_filename")


@query
def needs_speakers(spark: SparkSession, d: str) -> DataFrame:
    return C.needs_speakers(T.catalogue(spark, d)).select("video_id", "transcript_filename")


@query
def derived_filenames(spark: SparkSession, d: str) -> DataFrame:
    return C.derived_filenames(T.episodes(spark, d))


@query
def guest_hint(spark: SparkSession, d: str) -> DataFrame:
    return T.episodes(spark, d).select("video_id", E.guest_hint("description").alias("hint")).select(
        "video_id", "hint.phrase", "hint.name")


@query
def upsert_episodes(spark: SparkSession, d: str) -> DataFrame:
    stored, batch = T.stored_with_ordinal(spark, d), T.updates(spark, d)
    return _flat_episodes(C.upsert(stored, batch, unique=True))


@query
def update_existing(spark: SparkSession, d: str) -> DataFrame:
    return _flat_episodes(C.update_existing(T.stored_with_ordinal(spark, d), T.updates(spark, d)))


@query
def unmatched_updates(spark: SparkSession, d: str) -> DataFrame:
    return C.unmatched_updates(T.stored_with_ordinal(spark, d), T.updates(spark, d))


@query
def upsert_preserve_metadata(spark: SparkSession, d: str) -> DataFrame:
    kept = ("metadata", "audio_filename", "transcript_filename", "transcript_duration",
            "transcript_utterances")
    stored, batch = T.stored_with_ordinal(spark, d), T.updates(spark, d)
    return _flat_episodes(C.upsert_keeping_metadata(stored, batch, kept, unique=True))


@query
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_files(T.catalogue(spark, d), T.inventory(spark, d))


@query
def repair_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return _flat_episodes(C.without_missing_files(T.catalogue(spark, d), T.inventory(spark, d)))


@query
def episodes_with_files(spark: SparkSession, d: str) -> DataFrame:
    return C.with_existing_file(T.episodes(spark, d), T.inventory(spark, d)).select(
        "video_id", "audio_filename"
    )


@query
def transcript_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.with_coverage(_classified(spark, d)).select(
        "video_id", F.col("metadata.transcript_coverage").alias("coverage")
    )


@query
def speaker_count_estimate(spark: SparkSession, d: str) -> DataFrame:
    return C.with_speaker_estimate(_classified(spark, d)).select("video_id", "speaker_count")


@query
def verify_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.verify_stats(_classified(spark, d))


@query
def verify_missing(spark: SparkSession, d: str) -> DataFrame:
    return R.verify_missing(T.catalogue(spark, d))


# -- chunks ------------------------------------------------------------------

def _enriched(spark: SparkSession, d: str) -> DataFrame:
    chunks = K.with_context(T.utterances(spark, d))
    return K.enrich(chunks, C.classify(T.episodes(spark, d)), _lengths(spark, d, "n_lines"))


@query
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    return K.with_context(T.utterances(spark, d)).select("video_id", "pos", "previous", "next")


@query
def confidence_tier(spark: SparkSession, d: str) -> DataFrame:
    return T.utterances(spark, d).select(
        "video_id", "pos", "confidence", X.confidence_tier("confidence").alias("tier")
    )


@query
def enrich_utterances(spark: SparkSession, d: str) -> DataFrame:
    known = C.classify(T.episodes(spark, d))
    return K.enrich(T.utterances(spark, d), known, _lengths(spark, d, "n_lines")).select(
        "video_id", "pos", "episode_title", "episode_type", "episode_duration", "view_count",
        "like_count", "comment_count",
    )


@query
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    return _flat_chunks(K.chunk_documents(_enriched(spark, d)))


@query
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk records from nested transcript documents, the document form."""
    documents = T.transcript_documents(spark, d)
    known = C.classify(T.document_episodes(spark, d))
    return _flat_chunks(I.chunk_stream(documents, known))


@query
def attach_episode_metadata(spark: SparkSession, d: str) -> DataFrame:
    parsed = ST.accepted(_parsed(spark, d, stamped=False)).withColumn(
        "video_id", F.regexp_replace("file_name", "-.*$", "")
    )
    stamped = ST.attach_episode_metadata(parsed, _classified(spark, d))
    return stamped.select(
        "file_name", F.col("episode_metadata.video_id").alias("stamped_id"),
        F.col("episode_metadata.published_at").alias("published_at"),
        F.col("episode_metadata.duration_seconds").alias("duration_seconds"),
        F.col("episode_metadata.transcript_duration").alias("transcript_duration"),
    )


@query
def merge_short_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _flat_merged(K.merge_short_chunks(T.utterances(spark, d), dense=True))


@query
def merge_after_filter(spark: SparkSession, d: str) -> DataFrame:
    """Merging over gaps in positions: every fourth utterance is filtered out first."""
    return _flat_merged(K.merge_short_chunks(T.utterances(spark, d).where("pos % 4 <> 2")).drop(
        "previous", "next")).drop("previous", "next")


def _flat_merged(merged: DataFrame) -> DataFrame:
    if "previous" not in merged.columns:
        merged = merged.withColumns({"previous": F.lit(""), "next": F.lit("")})
    return merged.select(
        "video_id", "pos", "speaker", "transcript", "start", "end",
        F.round("confidence", 6).alias("confidence"), "speaker_confidence", "previous", "next",
    )


# -- turns and readable transcripts ------------------------------------------

def _readable(spark: SparkSession, d: str) -> DataFrame:
    episodes = C.with_coverage(_classified(spark, d))
    return U.readable_transcript(
        episodes, T.words(spark, d), _assigned(spark, d), _lengths(spark, d, "n_words")
    )


@query
def speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    return U.speaker_turns(T.words(spark, d)).select(
        "video_id", "turn_pos", "speaker", "start", "words", "text"
    )


@query
def document_turns(spark: SparkSession, d: str) -> DataFrame:
    return U.turns_in_document(_whole(spark, d))


# Long recordings, cut into small blocks: neighbours, turns, folds and samples cross many edges.

@query
def long_chunk_context(spark: SparkSession, d: str) -> DataFrame:
    return K.with_context(T.long_utterances(spark, d), block_rows=16).select(
        "video_id", "pos", "previous", "next")


@query
def long_speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    return U.speaker_turns(T.long_words(spark, d), block_rows=2).select(
        "video_id", "turn_pos", "speaker", "start", "words", "text")


@query
def long_merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _flat_merged(K.merge_short_chunks(
        T.long_utterances(spark, d), 40, block_rows=128, fold_rows=8, maps_per_group=2, dense=True))


@query
def long_transcript_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.transcript_sample(T.long_utterances(spark, d))


@query
def readable_header(spark: SparkSession, d: str) -> DataFrame:
    return U.header_lines(C.with_coverage(_classified(spark, d)))


@query
def readable_transcript(spark: SparkSession, d: str) -> DataFrame:
    return _readable(spark, d)


@query
def strip_labels(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat(F.lit("[00:01:23] [Speaker 3]: x "), "line")
    return _readable(spark, d).select(
        "video_id", "line_no",
        X.hide_labels("line", show_speakers=False).alias("bare"),
        X.hide_labels("line", show_speakers=False, show_timestamps=True).alias("timed"),
        X.hide_labels(both, show_speakers=False).alias("bracketed"),
    )


# -- samples and prompts -----------------------------------------------------

@query
def transcript_sample(spark: SparkSession, d: str) -> DataFrame:
    known = T.transcript_facts(spark, d).select("video_id")
    return S.transcript_sample(T.utterances(spark, d), known)


@query
def document_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_in_document(_whole(spark, d))


@query
def plain_transcript_sample(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("\n", F.split("description", "[ \n]+"))
    return T.episodes(spark, d).select("video_id", S.plain_sample(text).alias("sample"))


@query
def head_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.head_sample(_whole(spark, d))


@query
def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    return S.conversation_turns(S.transcript_sample(T.utterances(spark, d)))


@query
def speaker_prompts(spark: SparkSession, d: str) -> DataFrame:
    turns = S.conversation_turns(S.transcript_sample(T.utterances(spark, d)))
    asked = T.catalogue(spark, d).where("transcript_filename is not null")
    return S.speaker_prompts(asked, S.conversation_text(turns), HOSTS)


# -- speakers ----------------------------------------------------------------

def _assigned(spark: SparkSession, d: str) -> DataFrame:
    candidates = P.candidate_names(P.parse_responses(T.responses(spark, d)))
    return P.assign_names(P.speaker_stats(T.utterances(spark, d)), candidates)


@query
def speaker_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.speaker_stats(T.utterances(spark, d))


@query
def speaker_samples(spark: SparkSession, d: str) -> DataFrame:
    return P.speaker_samples(T.utterances(spark, d)).select(
        "video_id", "speaker", F.array_join("samples", "|").alias("samples")
    )


@query
def speaker_count(spark: SparkSession, d: str) -> DataFrame:
    return P.speaker_count(T.utterances(spark, d))


@query
def transcript_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.transcript_stats(T.utterances(spark, d))


@query
def document_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.document_stats(_whole(spark, d))


@query
def document_speakers(spark: SparkSession, d: str) -> DataFrame:
    return P.stats_in_document(_whole(spark, d)).withColumn("samples", F.array_join("samples", "|"))


@query
def speaker_rank(spark: SparkSession, d: str) -> DataFrame:
    return P.ranked_speakers(P.speaker_stats(T.utterances(spark, d))).select(
        "video_id", "speaker", "utterance_count", "speaker_rank"
    )


@query
def parse_speaker_response(spark: SparkSession, d: str) -> DataFrame:
    def names(c: str):
        return F.expr(
            f"array_join(transform({c}, p -> concat(p.name, '=',"
            " coalesce(cast(p.confidence as string), '-'))), '|')"
        ).alias(c)

    return P.parse_responses(T.responses(spark, d)).select(
        "video_id", names("hosts"), names("guests")
    )


@query
def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    return P.candidate_names(P.parse_responses(T.responses(spark, d)))


@query
def assign_speakers(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


@query
def speaker_roles(spark: SparkSession, d: str) -> DataFrame:
    return P.with_role(_assigned(spark, d)).select("video_id", "speaker", "name", "role")


@query
def speakers_map(spark: SparkSession, d: str) -> DataFrame:
    return P.speakers_map(_assigned(spark, d)).select(
        "video_id", F.expr(_map_text("speakers")).alias("speakers")
    )


def _map_text(column: str) -> str:
    return (
        f"array_join(transform(array_sort(map_keys({column})), k -> concat(k, ':',"
        f" {column}[k].name, '/', {column}[k].utterance_count)), '|')"
    )


@query
def speakers_map_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = P.merge_speakers(T.catalogue(spark, d), P.speakers_map(_assigned(spark, d)))
    return merged.select(
        "video_id", "speaker_count", F.expr(_map_text("metadata.speakers")).alias("speakers")
    )


# -- search ------------------------------------------------------------------

STOP_WORDS = ("the", "and", "of", "to", "is", "a", "in", "on", "der", "die", "le", "la", "de", "el")


def _term_counts(spark: SparkSession, d: str) -> DataFrame:
    stop_words = spark.createDataFrame([(w,) for w in STOP_WORDS], "term string")
    return Q.term_counts(T.table(spark, d, "documents"), stop_words)


@query
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to vector 7."""
    vectors = T.table(spark, d, "embeddings")
    given = vectors.where("vec_id = 7").select("embedding").first()["embedding"]
    return Q.nearest(vectors, given).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def similar_vectors_many(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to each vector whose id 50 divides, by a stored index."""
    vectors = T.table(spark, d, "embeddings")
    path = scratch_dir(spark, "vector-index")
    V.write_index(vectors, path, bits=5)
    given = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.search(spark, path, given, 10, probes=8, exact=True).select(
        "query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """Lines of transcripts with what searches filter by."""
    facts = C.classify(T.episodes(spark, d)).select(
        "video_id", F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.col("metadata.type").alias("type"))
    lines = T.utterances(spark, d).select(
        "video_id", F.concat_ws(":", "video_id", "pos").alias("doc_id"), F.col("transcript").alias("text"), "speaker")
    return lines.join(facts, "video_id").select("doc_id", "text", "speaker", "day", "type")


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEARCHES), "query_id int, text string, phrase boolean")


SEARCHES = ((1, "the and of", False), (2, "of the", True), (3, "The, the", True), (4, "That", False), (5, "to the a", False),
            (6, "nowhere", False))


@query
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Words and phrases in the lines of all transcripts, the best ten of each by BM25."""
    path = scratch_dir(spark, "text-index")
    FT.write_index(_spoken(spark, d), path, columns=("speaker", "day", "type"))
    return FT.search(spark, path, _searches(spark), 10)


@query
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among one speaker's lines in full episodes of some days, with the hits marked."""
    path, lines = scratch_dir(spark, "text-index"), _spoken(spark, d)
    FT.write_index(lines, path, columns=("speaker", "day", "type"))
    where = "speaker = 1 and type = 'FULL' and day between '2024-01-01' and '2024-01-03'"
    return FT.marked(FT.search(spark, path, _searches(spark), 5, where=where), _searches(spark), lines)


@query
def search_text(spark: SparkSession, d: str) -> DataFrame:
    documents = T.table(spark, d, "documents")
    return Q.search(documents, Q.term_table(documents), ("With", "from"), lang="en")


@query
def frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    return Q.frequent_terms(_term_counts(spark, d))


@query
def topic_timeline(spark: SparkSession, d: str) -> DataFrame:
    return Q.timeline(T.episodes(spark, d), Q.frequent_terms(_term_counts(spark, d), 10))


@query
def person_appearances(spark: SparkSession, d: str) -> DataFrame:
    return Q.appearances(T.utterances(spark, d), _assigned(spark, d))


@query
def person_quotes(spark: SparkSession, d: str) -> DataFrame:
    return Q.quotes(T.utterances(spark, d), _assigned(spark, d))


@query
def person_topics(spark: SparkSession, d: str) -> DataFrame:
    return TP.distinctive_terms(TP.person_terms(T.utterances(spark, d), _assigned(spark, d)))


@query
def topic_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of the 200 most frequent terms in the descriptions."""
    topics = Q.frequent_terms(_term_counts(spark, d), 200)
    return TP.bursts(TP.term_days(T.episodes(spark, d), topics))


@query
def collocations(spark: SparkSession, d: str) -> DataFrame:
    stop_words = spark.createDataFrame([(w,) for w in STOP_WORDS], "term string")
    return TP.collocations(T.table(spark, d, "documents"), stop_words)


@query
def corrections(spark: SparkSession, d: str) -> DataFrame:
    """What may be meant by terms typed without their second character, or with one too many or wrong."""
    counts = _term_counts(spark, d)
    typed = Q.frequent_terms(counts, 60).select(F.explode(F.expr(
        "array(concat(left(term, 1), substring(term, 3)), concat(term, 'x'), concat(left(term, 1), 'q', substring(term, 3)))"
    )).alias("typed"))
    return Q.corrections(typed, counts)


@query
def completions(spark: SparkSession, d: str) -> DataFrame:
    return Q.completions(_term_counts(spark, d))


@query
def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    return Q.usage(T.table(spark, d, "events"))


@query
def users_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Events and users per month from stored daily sketches, which hold few users exactly."""
    path = scratch_dir(spark, "daily-users")
    G.daily_users(T.table(spark, d, "events"), registers=18).write.parquet(path)
    return G.users_by(spark.read.parquet(path), F.expr("left(day, 7)"))


@query
def session_funnel(spark: SparkSession, d: str) -> DataFrame:
    return G.funnel(G.sessions(T.table(spark, d, "events"), STEPS, gap="8 hours"), len(STEPS))


STEPS = ("view", "click", "purchase")


# -- streams -----------------------------------------------------------------

def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them: a stream reads a
    single file only by a pattern."""
    return spark.readStream.schema(T.SCHEMAS[name]).parquet(f"{d}/{name}.parque[t]")


def _stored_known(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of the transcript documents, written once for all micro-batches."""
    return stored(C.classify(T.document_episodes(spark, d)), "stream-known")


@query
def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of transcript files as they land, some hundred files at a time, or a twentieth of very many:
    each micro-batch reads the catalogue, which is written once for all of them."""
    out = scratch_dir(spark, "stream-chunks")
    files = T.transcript_documents(spark, d).count()
    landed = ST.stream_transcripts(
        spark, _landed(spark, d, "landing"), names="part-*", per_trigger=max(300, -(-files // 20)), deep=True)
    known = _stored_known(spark, d)
    with read_by_cores(spark):
        (
            I.chunk_parsed(landed, known).writeStream.format("parquet")
            .option("path", f"{out}/chunks").option("checkpointLocation", f"{out}/progress")
            .trigger(availableNow=True).start().awaitTermination()
        )
    return _flat_chunks(spark.read.parquet(f"{out}/chunks"))


@query
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_dir(spark, "stream-upsert")
    SC.write_catalogue(T.catalogue(spark, d), f"{out}/base")
    T.updates(spark, d).repartition(3, "video_id").write.parquet(f"{out}/landed")
    landed = spark.read.parquet(f"{out}/landed")
    files = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1)
    (
        I.append_batches(files.parquet(f"{out}/landed"), f"{out}/batches")
        .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
        .awaitTermination()
    )
    I.fold_batches(spark.read.parquet(f"{out}/base"), spark.read.parquet(f"{out}/batches"), f"{out}/next")
    return _flat_episodes(spark.read.parquet(f"{out}/next"))


@query
def stream_type_counts(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_dir(spark, "stream-counts")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/counts")

    stream = T.episodes_of(_stream(spark, d, "documents"))
    (
        I.type_counts_by_day(stream).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True)
        .start().awaitTermination()
    )
    return spark.read.parquet(f"{out}/counts")


def _landed_twice(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Transcript files as they land, a third of them a second time, and a folder for what comes of them."""
    path = scratch_dir(spark, "landing-twice")
    # Turns are spread before documents, many times larger, are built of them.
    turns = T.table(spark, d, "conversations")
    first, again = (T.documents_of(T.by_document(turns, files)) for files in (9, 3))
    first.withColumn("turn", F.lit(1)).unionByName(
        again.where("xxhash64(file_name) % 3 = 0").withColumn("turn", F.lit(2))).withColumn(
        "landed_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(path)
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 5)
    return scratch_dir(spark, "landed"), I.once_each(files.parquet(path).drop("turn"))


@query
def stream_landing(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of files of which some land twice."""
    out, landed = _landed_twice(spark, d)
    I.land(landed, _stored_known(spark, d), out).option("checkpointLocation", f"{out}/progress").trigger(
        availableNow=True).start().awaitTermination()
    return _flat_chunks(spark.read.parquet(f"{out}/chunks"))


@query
def stream_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The files among them that give no chunks."""
    out, landed = _landed_twice(spark, d)
    I.land(landed, _stored_known(spark, d), out).option("checkpointLocation", f"{out}/progress").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rejects").select("file_name", "reason")


#: Catalogue rows in a file of a stream of many.
ROWS_PER_FILE = 20_000


@query
def stream_type_changes(spark: SparkSession, d: str) -> DataFrame:
    """Counts per type and day that follow a stream of upserts, updates with other lengths among them."""
    out = scratch_dir(spark, "type-changes")
    rows = stored(T.catalogue(spark, d).select(
        "video_id", "published_at", "duration", "metadata", F.lit(0).cast("bigint").alias("ordinal")), "type-changes-rows")
    changed = rows.where("cast(video_id as bigint) % 4 = 1").select(
        "video_id", F.expr("published_at + interval 1 day").alias("published_at"), F.lit("PT2M").alias("duration"),
        "metadata", F.lit(1).cast("bigint").alias("ordinal"))
    back = rows.where("cast(video_id as bigint) % 8 = 1").withColumn("ordinal", F.lit(2).cast("bigint"))
    # Each part is one micro-batch: one file, or as many as a large catalogue takes.
    n = max(1, rows.count() // ROWS_PER_FILE)
    for k, part in enumerate((rows, changed, back)):
        part.repartition(n).write.parquet(f"{out}/landed/part={k}")
    schema = spark.read.parquet(f"{out}/landed/part=0").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(f"{out}/landed/part=*")
    store = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        I.type_changes(C.classify(files)).writeStream.format("parquet").option("path", f"{out}/changes").option(
            "checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, held)
    return I.counted_changes(spark.read.parquet(f"{out}/changes"))
