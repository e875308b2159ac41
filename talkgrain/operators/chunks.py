"""Embedding-ready chunks: neighbouring context, catalogue enrichment, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.functions import transcripts as X
from talkgrain.plans import blocks
from talkgrain.sources.catalogue import iso_text

# Rows folded together when chunks are merged, and fold maps composed together.
FOLD_ROWS = 2048
MAPS_PER_GROUP = 4096


def with_context(
    utterances: DataFrame,
    *,
    chars: int = X.SNIPPET_CHARS,
    block_rows: int = blocks.BLOCK_ROWS,
    beyond: int = 0,
) -> DataFrame:
    """Add ``previous`` and ``next`` snippets, empty at the ends of a transcript.

    Row form, for transcripts of any length. Neighbours are shortened before
    they travel. The output stays partitioned on (video_id, block); ``beyond``
    is passed to :func:`blocks.with_neighbours`.
    """
    spread = utterances.withColumn("_cut", X.snippet("transcript", chars))
    near = blocks.with_neighbours(
        spread, "video_id", "pos", previous={"previous": "_cut"}, following={"next": "_cut"},
        beyond=beyond, size=block_rows,
    )
    return near.drop("_cut").withColumns({
        "previous": F.coalesce("previous", F.lit("")),
        "next": F.coalesce("next", F.lit("")),
    })


def context_in_document(
    transcripts: DataFrame, *, chars: int = X.SNIPPET_CHARS, also: Sequence[str] = ()
) -> DataFrame:
    """Chunk rows straight from transcript documents, without any shuffle.

    Neighbours are read from the document's own array, so this also runs on a
    stream of newly landed documents. ``also`` names columns to keep.
    """
    cut = "if(length({0}) <= {1}, {0}, concat(substring({0}, 1, {1}), '...'))"
    texts = "get(results.utterances, i {}).transcript"
    chunk = (
        "transform(results.utterances, (u, i) -> named_struct("
        "'pos', cast(i as bigint), 'u', u,"
        f" 'previous', if(i = 0, '', coalesce({cut.format(texts.format('- 1'), chars)}, '')),"
        f" 'next', coalesce({cut.format(texts.format('+ 1'), chars)}, '')))"
    )
    return transcripts.select(
        F.col("episode_metadata.video_id").alias("video_id"),
        F.col("episode_metadata.title").alias("episode_title"),
        F.try_to_timestamp("episode_metadata.published_at").alias("published_at"),
        *also,
        F.explode(F.expr(chunk)).alias("c"),
    ).select("video_id", "episode_title", "published_at", *also,
             "c.pos", "c.u.*", "c.previous", "c.next")


# What makes a whole document unusable: all of its utterances or none become chunks.
UNSTAMPED = (
    "(episode_metadata.video_id is null or episode_metadata.title is null"
    " or episode_metadata.published_at is null)"
)
UNDATED = "try_to_timestamp(episode_metadata.published_at) is null"
INCOMPLETE = (
    "coalesce(exists(results.utterances, u -> u.speaker is null or u.confidence is null"
    " or u.start is null or u.end is null or u.transcript is null), true)"
)


def readable_documents(transcripts: DataFrame) -> DataFrame:
    """Documents with episode metadata, a date that can be read and complete utterances."""
    return transcripts.where(f"not ({UNSTAMPED} or {UNDATED} or {INCOMPLETE})")


def enrich(
    rows: DataFrame,
    episodes: DataFrame,
    lengths: DataFrame | None = None,
    *,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Left join catalogue columns to utterance or chunk rows, block by block.

    Rows of unknown episodes stay, with the defaults of an absent one. Where rows
    state ``episode_title`` and ``published_at`` themselves, as transcripts do,
    these stay and the catalogue fills what is null.
    ``lengths`` (video_id, length) states how many positions each transcript
    has, where that is known, as the catalogue records it; else it is counted.
    """
    if lengths is None:
        lengths = blocks.lengths_of(rows, "video_id", "pos")
    in_use = blocks.blocks_in_use(lengths, "video_id", size=block_rows)
    if "block" not in rows.columns:
        rows = rows.withColumn("block", blocks.block_of("pos", block_rows))
    own = [c for c in ("episode_title", "published_at") if c in rows.columns]
    known = _catalogue_columns(episodes).withColumnsRenamed({c: f"_{c}" for c in own})
    joined = blocks.attach_by_block(rows, known, in_use, "video_id")
    joined = joined.withColumns({c: F.coalesce(c, f"_{c}") for c in own}).drop(*[f"_{c}" for c in own])
    return _with_defaults(joined)


def document_chunk_rows(transcripts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Chunk rows with context and catalogue columns from readable documents.

    Title and date are the document's own. The catalogue meets whole documents,
    one row each; they are exploded after that.
    """
    known = _catalogue_columns(episodes).drop("episode_title", "published_at")
    also = [c for c in known.columns if c != "video_id"]
    stamped = transcripts.withColumn("video_id", F.col("episode_metadata.video_id"))
    joined = stamped.join(known, "video_id", "left")
    return _with_defaults(context_in_document(joined, also=also))


def _catalogue_columns(episodes: DataFrame) -> DataFrame:
    return episodes.select(
        "video_id",
        F.col("title").alias("episode_title"),
        "published_at",
        F.col("metadata.type").alias("episode_type"),
        F.col("metadata.duration_seconds").alias("episode_duration"),
        F.col("description").alias("episode_description"),
        "tags",
        "view_count",
        "like_count",
        "comment_count",
    )


def _with_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "episode_type": F.coalesce("episode_type", F.lit("UNKNOWN")),
        "episode_description": F.coalesce("episode_description", F.lit("")),
        "tags": F.coalesce("tags", F.expr("cast(array() as array<string>)")),
    })


def chunk_documents(enriched: DataFrame) -> DataFrame:
    """The nested chunk record, from rows with context and catalogue columns."""
    seconds = F.round(F.col("end") - F.col("start"), 2)
    return enriched.select(
        F.col("transcript").alias("content"),
        F.col("start").alias("start_time"),
        F.col("end").alias("end_time"),
        seconds.alias("duration"),
        F.col("speaker").alias("speaker_id"),
        F.round(F.coalesce("speaker_confidence", F.lit(0.0)), 3).alias("speaker_confidence"),
        "video_id",
        "episode_title",
        iso_text("published_at").alias("published_at"),
        "episode_type",
        "episode_duration",
        "episode_description",
        "tags",
        F.struct("view_count", "like_count", "comment_count").alias("statistics"),
        F.col("pos").alias("chunk_index"),
        F.struct("previous", "next").alias("context"),
        F.round("confidence", 3).alias("confidence_score"),
        X.chunk_id("video_id", "pos").alias("chunk_id"),
        F.col("start").alias("timestamp"),
        F.struct(
            F.year("published_at").alias("year"),
            F.month("published_at").alias("month"),
            F.dayofmonth("published_at").alias("day"),
            seconds.alias("duration_seconds"),
            X.confidence_tier("confidence").alias("confidence_tier"),
            "episode_type",
            (F.size("tags") > 0).alias("has_tags"),
            F.struct(
                F.col("view_count").alias("views"),
                F.col("like_count").alias("likes"),
                F.col("comment_count").alias("comments"),
            ).alias("engagement_metrics"),
        ).alias("metadata"),
    )


# -- merging short chunks ----------------------------------------------------
#
# Merging is greedy: a chunk takes the next row while the speaker is the same and
# the two lengths fit, so where a chunk ends depends on where it began, and that
# on the chunk before. Rows are folded FOLD_ROWS at a time; what a fold needs from
# the past is only the offset of the first chunk that begins inside it. For full
# folds (which have a successor to serve) the whole function "first begin in this
# fold -> first begin in the next" is tabulated. Such functions compose
# associatively, so they are combined in groups, the groups in sequence, and each
# fold reads off its own begin. Recordings shorter than a fold skip all of it;
# one of 10**11 rows has about 12,000 groups of 4,096 maps, 2 KB a map.


def merge_short_chunks(
    rows: DataFrame,
    max_chars: int = X.MAX_CHUNK_CHARS,
    *,
    block_rows: int = blocks.BLOCK_ROWS,
    fold_rows: int = FOLD_ROWS,
    maps_per_group: int = MAPS_PER_GROUP,
    dense: bool = False,
) -> DataFrame:
    """Merge consecutive chunks of one speaker while they fit ``max_chars``.

    Positions may have gaps, as after a filter: rows are consecutive by order.
    ``dense`` says that there are none, which saves the numbering.

    ``rows`` are utterances, to which context is added on the way, or chunk rows
    that have ``previous`` and ``next`` already. The first row gives a merged
    chunk its index, start, previous context and speaker confidence; the last one
    its end and next context; confidence is the running pairwise mean.

    Context, folds and begins all use the partitioning on (video_id, block), so
    the rows are shuffled once.
    """
    # A chunk grows by at least the joining space per row, hence its longest run.
    reach = max_chars + 2
    fold_rows = max(fold_rows, reach + 1)
    folds = max(block_rows // fold_rows, 1)
    size = folds * fold_rows
    plain = rows.drop("block") if "block" in rows.columns else rows
    if not dense:
        plain = blocks.with_dense_positions(plain, "video_id", "pos", "_at", size).withColumnsRenamed(
            {"pos": "_pos", "_at": "pos"})
    else:
        plain = plain.withColumn("_pos", F.col("pos"))
    if "previous" in rows.columns:
        near = blocks.with_halo(plain, "pos", after=reach, size=size)
    else:
        near = with_context(plain, block_rows=size, beyond=reach)
    # A row is part of its own fold and, near its start, visible to the one before.
    home = f"pos div {fold_rows}"
    places = (
        f"array_compact(array(if(pos div {size} = block, {home}, null),"
        f" if(pos % {fold_rows} < {reach} and {home} > block * {folds}, {home} - 1, null)))"
    )
    item = F.struct(
        "pos", "_pos", "speaker", F.coalesce("transcript", F.lit("")).alias("text"), "start", "end",
        "confidence", "speaker_confidence", "previous", "next",
    )
    arrays = (
        near.withColumn("fold", F.explode(F.expr(places)))
        .groupBy("video_id", "block", "fold")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    begins = _fold_begins(plain, max_chars, reach, fold_rows, maps_per_group)
    per_block = begins.withColumn("block", F.expr(f"fold div {folds}")).groupBy(
        "video_id", "block"
    ).agg(F.map_from_entries(F.collect_list(
        F.struct("fold", F.struct("begin", "stop")))).alias("begins"))
    own = F.expr(
        f"filter(items, x -> x.pos >= fold * {fold_rows} + coalesce(begins[fold].begin, 0) and"
        f" (begins[fold].stop is null or x.pos < (fold + 1) * {fold_rows} + begins[fold].stop))"
    )
    # First the positions at which chunks begin, then each chunk from its stretch.
    begin_at = F.expr(f"""
        aggregate(
          own,
          named_struct('at', cast(array() as array<bigint>), 'speaker', cast(null as int),
                       'chars', -1),
          (s, x) -> if(
            s.chars >= 0 and s.speaker <=> x.speaker
              and s.chars + length(x.text) <= {max_chars},
            named_struct('at', s.at, 'speaker', s.speaker,
                         'chars', s.chars + length(x.text) + 1),
            named_struct('at', array_append(s.at, x.pos), 'speaker', x.speaker,
                         'chars', length(x.text))),
          s -> s.at)
    """)
    stretches = F.expr(
        "transform(at, (p, i) -> slice(own, cast(p - at[0] as int) + 1,"
        " cast(coalesce(get(at, i + 1), at[0] + size(own)) - p as int)))"
    )
    return (
        arrays.join(per_block, ["video_id", "block"], "left")
        .select("video_id", own.alias("own"))
        .select("video_id", "own", begin_at.alias("at"))
        .select("video_id", F.explode(stretches).alias("c"))
        .select("video_id", F.col("c")[0].alias("first"), "c")
        .select(
            "video_id", F.col("first._pos").alias("pos"), "first.speaker",
            F.array_join("c.text", " ").alias("transcript"),
            "first.start",
            F.element_at("c", -1)["end"].alias("end"),
            F.expr("aggregate(slice(c, 2, size(c)), first.confidence,"
                   " (a, x) -> (a + x.confidence) / 2)").alias("confidence"),
            "first.speaker_confidence", "first.previous",
            F.element_at("c", -1)["next"].alias("next"),
        )
    )


def _fold_begins(
    rows: DataFrame, max_chars: int, reach: int, fold_rows: int, maps_per_group: int
) -> DataFrame:
    """(video_id, fold, begin, stop) for folds of recordings longer than one fold.

    ``begin`` is the offset of the first chunk begun in the fold; ``stop`` the
    same for the next fold, null in the last one. Only lengths and speakers of
    full folds take part.
    """
    slim = rows.select(
        "video_id", "pos",
        F.coalesce(F.length("transcript"), F.lit(0)).alias("chars"),
        # An absent speaker is a value that no id has.
        F.coalesce(F.col("speaker").cast("bigint"), F.lit(-(1 << 63))).alias("speaker"),
    )
    full = slim.where(f"pos % {fold_rows} = {fold_rows - 1}").select(
        "video_id", F.expr(f"pos div {fold_rows}").alias("fold")
    )
    inside = F.sort_array(F.collect_list(F.struct("pos", "chars", "speaker")))
    arrays = (
        blocks.with_halo(slim, "pos", after=reach, size=fold_rows, block="fold")
        .join(full, ["video_id", "fold"], "left_semi")
        .groupBy("video_id", "fold").agg(inside.alias("x"))
        .select("video_id", "fold", F.col("x.chars").alias("lengths"),
                F.col("x.speaker").alias("speakers"))
    )
    kind = dict(arrays.dtypes)
    maps = arrays.mapInArrow(
        fold_maps(max_chars, fold_rows, reach),
        f"video_id {kind['video_id']}, fold {kind['fold']}, map array<int>",
    ).withColumn("grp", F.expr(f"fold div {maps_per_group}"))
    # Said here so that both uses of the groups have one plan, and share one shuffle.
    maps = maps.where("video_id is not null and grp is not null")

    in_order = F.sort_array(F.collect_list(F.struct("fold", "map")))
    groups = maps.groupBy("video_id", "grp").agg(in_order.alias("ms"))
    through = F.expr(
        f"aggregate(ms, sequence(0, {reach - 1}), (acc, m) -> transform(acc, e -> get(m.map, e)))"
    )
    composed = groups.select("video_id", "grp", through.alias("map"))
    # Offsets at which each member of a list of maps is entered, from a first one.
    entered = (
        "aggregate({0}, array({1}), (acc, m) ->"
        " array_append(acc, get(m.map, element_at(acc, -1))))"
    )
    group_entries = (
        composed.groupBy("video_id")
        .agg(F.sort_array(F.collect_list(F.struct("grp", "map"))).alias("gs"))
        .select("video_id", "gs.grp", F.expr(entered.format("gs", "0")).alias("at"))
        .select("video_id", F.explode(F.expr(
            "transform(grp, (g, i) -> named_struct('grp', g, 'at', get(at, i)))")).alias("g"))
        .select("video_id", "g.*")
    )
    # A group of maps with its entry gives each fold its begin and its stop; the
    # fold after the last full one begins where that one stops.
    stops = (
        groups.join(group_entries, ["video_id", "grp"])
        .select("video_id", "ms.fold", F.expr(entered.format("ms", "at")).alias("at"))
        .select("video_id", F.explode(F.expr(
            "transform(fold, (f, i) -> named_struct("
            "'fold', f, 'begin', get(at, i), 'stop', get(at, i + 1)))")).alias("b"))
        .select("video_id", "b.*")
    )
    both = stops.select("video_id", F.explode(F.expr(
        "array(named_struct('fold', fold, 'begin', begin, 'stop', stop),"
        " named_struct('fold', fold + 1, 'begin', stop, 'stop', cast(null as int)))")).alias("b"))
    return both.groupBy("video_id", "b.fold").agg(
        F.max("b.begin").alias("begin"), F.max("b.stop").alias("stop")
    )


def fold_maps(
    max_chars: int, size: int, reach: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: (video_id, fold, lengths, speakers) to (video_id, fold, map).

    ``lengths`` and ``speakers`` cover one full fold and the rows that follow it
    (at most ``reach``). Entry ``e`` of the map tells where the chain of chunks
    begun at offset ``e`` enters the next fold. Nothing outside this function is
    referenced, so executors need no copy of the package.
    """
    def next_begins(lengths: np.ndarray, speakers: np.ndarray) -> np.ndarray:
        n = len(lengths)
        here = np.arange(n)
        ends = np.cumsum(lengths.astype(np.int64) + 1)   # merged length up to a row, plus one
        before = np.concatenate(([0], ends[:-1]))
        # A chunk begun at i takes row j while ends[j] - before[i] - 2 <= max_chars.
        full = np.searchsorted(ends, before + max_chars + 2, side="right")
        changes = np.append(np.flatnonzero(speakers[1:] != speakers[:-1]) + 1, n)
        same = changes[np.searchsorted(changes, here, side="right")]
        leaves = np.append(np.maximum(np.minimum(full, same), here + 1), n)
        leaves[size:] = np.arange(size, n + 1)
        # Each round doubles the steps taken; what has left the fold stays where it is.
        for _ in range(size.bit_length()):
            leaves = leaves[leaves]
        return (leaves[:reach] - size).astype(np.int32)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("lengths"), batch.column("speakers"), strict=True)
            maps = [next_begins(n.values.to_numpy(), s.values.to_numpy()) for n, s in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("video_id"), batch.column("fold"),
                 pa.array(maps, type=pa.list_(pa.int32()))],
                names=["video_id", "fold", "map"],
            )

    return tabulate
