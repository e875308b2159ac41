import pytest
from pyspark.sql import functions as F

from talkgrain import schemas
from talkgrain.operators import catalogue as C
from talkgrain.operators import report as R
from talkgrain.sources.catalogue import typed_episodes


def table(spark, *rows):
    schema = schemas.struct_type(f"ordinal: bigint, {schemas.EPISODE_FILE_DDL}")
    return typed_episodes(spark.createDataFrame(
        [{"ordinal": i, "published_at": "2024-01-01T00:00:00"} | r for i, r in enumerate(rows)],
        schema))


def titles(df):
    return sorted((r.video_id, r.title) for r in df.collect())


@pytest.fixture
def stored(spark):
    return table(
        spark,
        {"video_id": "a", "title": "a0", "view_count": 5, "audio_filename": "a.mp3",
         "metadata": {"type": "FULL", "duration_seconds": 600}},
        {"video_id": "b", "title": "b0"},
        {"video_id": "b", "title": "b1"},
    )


@pytest.fixture
def batch(spark):
    return table(
        spark,
        {"video_id": "a", "title": "a-new", "metadata": {"type": "SHORT"}},
        {"video_id": "n", "title": "n0"},
        {"video_id": "n", "title": "n1"},
    )


def test_dedup_keeps_the_last(stored):
    assert titles(C.dedup_catalogue(stored)) == [("a", "a0"), ("b", "b1")]


def test_upsert(stored, batch):
    got = C.upsert(stored, batch)
    assert titles(got) == [("a", "a-new"), ("b", "b1"), ("n", "n1")]
    a = got.where("video_id = 'a'").first()
    assert a.view_count is None and a.audio_filename is None and a.metadata.type == "SHORT"


def test_upsert_into_a_unique_catalogue(stored, batch):
    once = C.dedup_catalogue(stored)
    key = lambda r: r.video_id
    assert sorted(C.upsert(once, batch, unique=True).collect(), key=key) == sorted(
        C.upsert(once, batch).collect(), key=key)
    assert sorted(C.upsert_keeping_metadata(once, batch, unique=True).collect(), key=key) == sorted(
        C.upsert_keeping_metadata(once, batch).collect(), key=key)


def test_update_existing_takes_nulls_and_ignores_new(stored, batch):
    got = C.update_existing(C.dedup_catalogue(stored), batch)
    assert titles(got) == [("a", "a-new"), ("b", "b1")]
    assert got.where("video_id = 'a'").first().view_count is None
    assert [r.video_id for r in C.unmatched_updates(stored, batch).collect()] == ["n"]


def test_upsert_keeping_metadata(stored, batch):
    kept = C.upsert_keeping_metadata(stored, batch).where("video_id = 'a'").first()
    assert (kept.title, kept.metadata.type, kept.metadata.duration_seconds) == ("a-new", "FULL", 600)
    assert kept.audio_filename is None
    files = C.upsert_keeping_metadata(stored, batch, ("metadata", "audio_filename"))
    assert files.where("video_id = 'a'").first().audio_filename == "a.mp3"
    fresh = C.upsert_keeping_metadata(batch.where("false"), batch).where("video_id = 'a'").first()
    assert fresh.metadata.type == "SHORT"


def test_ids_are_trimmed_and_unknown_ones_dropped(stored):
    assert titles(C.episodes_by_ids(stored, " a ,,zzz, ")) == [("a", "a0")]
    assert C.episodes_by_ids(stored, "").count() == 0
    assert titles(C.episode_by_id(stored, "a")) == [("a", "a0")]


def test_stage_filters(spark):
    rows = C.classify(table(
        spark,
        {"video_id": "f", "duration": "PT3M", "webm_filename": "f.webm", "audio_filename": ""},
        {"video_id": "s", "duration": "PT2M59S", "audio_filename": "s.mp3",
         "transcript_filename": "s.json"},
        {"video_id": "d", "duration": None, "webm_filename": "", "transcript_filename": "d.json",
         "metadata": {"speakers": {}}},
    ))

    def ids(df):
        return sorted(r.video_id for r in df.collect())

    assert ids(C.needs_download(rows)) == ["f"]
    assert ids(C.needs_download(rows, full_only=False)) == ["d", "f", "s"]
    assert ids(C.needs_convert(rows)) == ["f"]
    assert ids(C.needs_transcribe(rows)) == ["s"]
    assert ids(C.needs_speakers(rows)) == ["s"]
    assert ids(C.needs_speakers(rows, force=True)) == ["d", "s"]
    assert [(r.part, r.duration) for r in C.listing(rows).orderBy("part", "duration").collect()] == [
        (0, "0:03:00"), (1, "0:00:00"), (1, "0:02:59")]


def test_latest(spark):
    rows = table(spark, *[{"video_id": str(i), "published_at": f"2024-01-0{i}T00:00:00"}
                          for i in range(1, 6)])
    assert [r.video_id for r in C.latest(rows, 2).collect()] == ["5", "4"]
    assert C.latest(rows, 0).count() == 5


def test_files(spark):
    rows = table(
        spark,
        {"video_id": "a", "audio_filename": "a.mp3", "transcript_filename": "a.json"},
        {"video_id": "b", "audio_filename": "b.mp3", "transcript_filename": ""},
        {"video_id": "c"},
    )
    inventory = spark.createDataFrame([("a.mp3",), ("a.mp3",), ("x.json",)], "file_name string")
    assert sorted(map(tuple, C.missing_files(rows, inventory).collect())) == [
        ("a", "transcript", "a.json"), ("b", "audio", "b.mp3")]
    repaired = C.without_missing_files(rows, inventory).orderBy("video_id").collect()
    assert [(r.video_id, r.audio_filename, r.transcript_filename) for r in repaired] == [
        ("a", "a.mp3", None), ("b", None, ""), ("c", None, None)]
    assert titles(C.with_existing_file(rows, inventory)) == [("a", None)]
    assert C.with_existing_file(rows, inventory, limit=1).count() == 1


def test_coverage_and_estimate(spark):
    rows = table(
        spark,
        {"video_id": "a", "transcript_duration": 30.0, "transcript_utterances": 25,
         "metadata": {"duration_seconds": 60}},
        {"video_id": "b", "transcript_duration": 30.0, "transcript_utterances": 25,
         "speaker_count": 7, "metadata": {"duration_seconds": 60}},
        {"video_id": "c", "transcript_duration": 30.0, "transcript_utterances": 25},
        {"video_id": "d", "transcript_duration": 30.0, "transcript_utterances": 0,
         "metadata": {"duration_seconds": 60}},
    )
    got = C.with_speaker_estimate(C.with_coverage(rows)).orderBy("video_id").collect()
    assert [(r.metadata.transcript_coverage, r.speaker_count) for r in got] == [
        (50.0, 2), (50.0, 7), (None, None), (50.0, None)]


def test_report(spark):
    rows = table(spark, *[
        {"video_id": f"{i:02}", "title": f"t{i}", "audio_filename": "x" if i < 3 else "",
         "published_at": f"2024-01-{i + 1:02}T00:00:00",
         "metadata": {"type": "FULL" if i % 2 else "SHORT", "speakers": {}}}
        for i in range(16)
    ])
    stats = R.verify_stats(rows).first()
    assert (stats.total_episodes, stats.full_episodes, stats.shorts) == (16, 8, 8)
    assert (stats.with_audio, stats.audio_percent, stats.with_speakers) == (3, 18.8, 0)
    missing = R.verify_missing(rows).where("category = 'audio'").orderBy("rank").collect()
    assert len(missing) == 10 and missing[0].video_id == "15"
    assert {(r.missing, r.more) for r in missing} == {(13, 3)}
    empty = R.verify_stats(rows.where(F.lit(False))).first()
    assert empty.total_episodes == 0 and empty.audio_percent is None
