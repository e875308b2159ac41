"""What the physical plans must, and must not, contain."""

import re

import pytest

from conftest import SMALL
from talkgrain.operators import catalogue as C
from talkgrain.operators import chunks as K
from talkgrain.operators import speakers as P
from talkgrain.plans import tables as T
from talkgrain.plans.queries import QUERIES

STREAMS_AND_FILES = {
    "stream_chunks", "stream_upsert", "stream_type_counts", "scan_episodes", "scan_catalogue_documents",
    "catalogue_version", "chunk_files", "readable_files", "scan_catalogue_lines", "transcript_files", "file_inventory",
    "flatten_video_items",
}


def plan_of(spark, name, threshold="10485760"):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        frame = QUERIES[name](spark, SMALL)
        return frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS_AND_FILES))
def test_no_nested_loops_and_no_row_udfs(spark, name):
    plan = plan_of(spark, name, "-1")
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                 "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "SinglePartition"):
        if node == "SinglePartition" and name in ("verify_stats",):
            continue
        assert node not in plan, node


@pytest.mark.parametrize("name", ["chunk_context", "chunk_records", "merge_short_chunks",
                                  "speaker_turns", "readable_transcript"])
def test_no_window_sorts_a_whole_recording(spark, name):
    """Windows over a transcript are cut by block; those by video see block totals only."""
    for line in plan_of(spark, name, "-1").splitlines():
        keys = re.search(r"windowspecdefinition\((\w+)#\d+, (\w+)#", line)
        if keys and keys.group(1) == "video_id":
            totals = re.search(r"_total_|max\(_last", line)
            by_rank = re.search(r"row_number\(\)", line)
            assert keys.group(2) in ("block", "turn_block", "stretch", "_dense", "first_pos") or totals or by_rank, line[:300]


@pytest.mark.parametrize("name,limit", [("speaker_samples", 10), ("verify_missing", 10),
                                        ("update_existing", 1), ("dedup_catalogue_last", 1)])
def test_rank_filters_run_before_the_shuffle(spark, name, limit):
    plan = plan_of(spark, name)
    assert re.search(rf"WindowGroupLimit .*{limit}, Partial", plan)


def test_a_small_batch_does_not_move_the_catalogue(spark, tmp_path):
    T.stored_with_ordinal(spark, SMALL).write.parquet(str(tmp_path / "stored"))
    T.updates(spark, SMALL).write.parquet(str(tmp_path / "batch"))
    merged = C.upsert(
        spark.read.parquet(str(tmp_path / "stored")), spark.read.parquet(str(tmp_path / "batch")),
        unique=True,
    )
    plan = merged._jdf.queryExecution().executedPlan().toString()
    stored = plan[: plan.index("FileScan")]
    assert "LeftAnti" in stored and "BroadcastHashJoin" in stored
    assert "Exchange hash" not in stored


def test_limits_are_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "latest_episodes")


def test_scans_read_only_what_is_needed(spark):
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan_of(spark, "parse_duration")
    assert "ReadSchema: struct<n_chars:bigint>" in plan_of(spark, "type_summary")


def test_merging_shuffles_the_rows_once(spark, tmp_path):
    T.utterances(spark, SMALL).write.parquet(str(tmp_path / "utterances"))
    merged = K.merge_short_chunks(
        spark.read.parquet(str(tmp_path / "utterances")), dense=True)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan[: plan.index("FileScan")].splitlines() if "Exchange hash" in x]
    assert len(wide) == 1


def test_enrichment_shuffles_the_long_side_once(spark):
    """Context windows and the catalogue join share one exchange of the utterances."""
    plan = plan_of(spark, "chunk_records", "-1")
    head = plan[: plan.index("FileScan")]
    long_side = [x for x in head.splitlines() if "Exchange hashpartitioning" in x]
    assert len(long_side) == 2      # one for the positions, one for context and join


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return len([x for x in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange hash" in x])


def test_assigning_names_takes_two_exchanges(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        P.speaker_stats(T.utterances(spark, SMALL)).write.parquet(str(tmp_path / "stats"))
        P.candidate_names(P.parse_responses(T.responses(spark, SMALL))).write.parquet(str(tmp_path / "names"))
        stats, names = (spark.read.parquet(str(tmp_path / x)) for x in ("stats", "names"))
        assert exchanges(P.ranked_speakers(stats)) == 1
        assert exchanges(P.assign_names(stats, names)) == 2
        T.catalogue(spark, SMALL).write.parquet(str(tmp_path / "catalogue"))
        T.inventory(spark, SMALL).write.parquet(str(tmp_path / "files"))
        repaired = C.without_missing_files(
            spark.read.parquet(str(tmp_path / "catalogue")), spark.read.parquet(str(tmp_path / "files")))
        wide = [x for x in repaired._jdf.queryExecution().executedPlan().toString().splitlines()
                if "FileScan" in x and "description" in x]
        assert len(wide) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["document_turns", "document_speakers", "document_stats", "head_sample"])
def test_document_forms_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(spark, name)
