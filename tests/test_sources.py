import json

import pytest
from pyspark.sql import functions as F

from talkgrain.operators import chunks as K
from talkgrain.plans import tables as T
from talkgrain.sources import catalogue as SC
from talkgrain.sources import transcripts as ST


def utterance(text, speaker=0, **more):
    return {"transcript": text, "start": 0.0, "end": 1.0, "speaker": speaker,
            "confidence": 0.95} | more


def document(video, utterances, **more):
    return {
        "results": {"duration": 9.5, "utterances": utterances},
        "episode_metadata": {"video_id": video, "title": f"Title {video}",
                             "published_at": "2024-02-03T04:05:06Z"},
    } | more


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "transcripts"
    folder.mkdir()
    words = [{"word": "hi", "start": 0.1, "speaker": 0}, {"punctuated_word": "You."}]
    two = document("two", [utterance("only"), {"transcript": "no speaker"}])
    two["results"]["channels"] = [{"alternatives": [{"words": words}]}]
    two["metadata"] = {"speakers": [{"id": 0, "name": "Ann"}]}
    files = {
        "one.json": json.dumps(document("one", [utterance("a"), utterance("b", 1)]), indent=2),
        "two.json": json.dumps(two),
        "bad.json": '{"results": {"duration": 1',
        "notes.txt": "not a transcript",
    }
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def test_bad_files_are_rejected_and_the_rest_kept(spark, landed):
    files = ST.read_transcripts(spark, landed).cache()
    assert sorted(r.file_name for r in ST.accepted(files).collect()) == ["one.json", "two.json"]
    bad = ST.rejected(files).collect()
    assert [r.file_name for r in bad] == ["bad.json"] and bad[0]._corrupt_record


def test_utterances_words_and_names(spark, landed):
    files = ST.accepted(ST.read_transcripts(spark, landed).cache())
    said = sorted((r.video_id, r.pos, r.transcript, r.speaker)
                  for r in ST.utterances(files).collect() if r.speaker is not None)
    assert said == [("one", 0, "a", 0), ("one", 1, "b", 1), ("two", 0, "only", 0)]
    words = sorted((r.video_id, -1 if r.pos is None else r.pos, r.word, r.punctuated_word)
                   for r in ST.words(files).collect())
    assert words == [("one", -1, None, None), ("two", 0, "hi", None), ("two", 1, None, "You.")]
    assert [tuple(r) for r in ST.speaker_names(files).collect()] == [("two", 0, "Ann")]


def test_one_incomplete_utterance_stops_a_document(spark, landed):
    files = ST.accepted(ST.read_transcripts(spark, landed).cache())
    rows = K.context_in_document(K.readable_documents(files)).orderBy("pos").collect()
    assert [(r.video_id, r.transcript, r.previous, r.next) for r in rows] == [
        ("one", "a", "", "b"), ("one", "b", "a", "")]


def test_json_export_round_trip(spark, landed):
    files = ST.accepted(ST.read_transcripts(spark, landed).cache())
    again = ST.accepted(ST.parse_transcripts(ST.as_json(files)))
    key = ["file_name", "results", "metadata", "episode_metadata"]
    assert sorted(map(str, again.select(key).collect())) == sorted(
        map(str, files.select(key).collect()))


def test_metadata_is_stamped_only_where_absent(spark):
    texts = spark.createDataFrame(
        [("a.json", json.dumps(document("a", []))), ("b.json", '{"results": {}}'),
         ("c.json", '{"results": {}}')], "file_name string, document string")
    parsed = ST.parse_transcripts(texts).withColumn("video_id", F.substring("file_name", 1, 1))
    rows = [{"video_id": v, "title": f"stored {v}", "published_at": "2024-01-01T00:00:00",
             "metadata": {"duration_seconds": 60}} for v in "ab"]
    from talkgrain import schemas
    episodes = SC.typed_episodes(
        spark.createDataFrame(rows, schemas.struct_type(schemas.EPISODE_FILE_DDL)))
    got = ST.attach_episode_metadata(parsed, episodes).collect()
    assert {r.video_id: r.episode_metadata.title for r in got} == {
        "a": "Title a", "b": "stored b"}


def test_catalogue_documents(spark, tmp_path):
    good = {"episodes": [
        {"video_id": "a", "title": "A", "published_at": "2024-02-03T04:05:06+00:00", "tags": ["x"],
         "metadata": {"type": "FULL", "speakers": {"0": {"name": "Ann", "utterance_count": 3}}}},
        {"video_id": "b", "published_at": "2024-02-03T04:05:06"},
    ]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "bad.json").write_text('{"episodes": [')
    rows = SC.read_catalogue(spark, str(tmp_path / "good.json")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.video_id, r.tags) for r in rows] == [(0, "a", ["x"]), (1, "b", [])]
    assert rows[0].metadata.speakers["0"].name == "Ann"
    assert rows[1].metadata is not None and rows[1].metadata.type is None
    assert rows[0].published_at == rows[1].published_at
    assert SC.read_catalogue(spark, str(tmp_path / "bad.json")).count() == 0


def test_catalogue_versions_are_not_overwritten(spark, tmp_path):
    rows = SC.read_catalogue_lines(spark, _lines(tmp_path))
    SC.write_catalogue(rows, str(tmp_path / "v1"))
    assert spark.read.parquet(str(tmp_path / "v1")).count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        SC.write_catalogue(rows, str(tmp_path / "v1"))
    SC.write_catalogue_lines(rows, str(tmp_path / "lines"))
    again = SC.read_catalogue_lines(spark, str(tmp_path / "lines"))
    assert again.collect() == rows.collect()


def _lines(folder):
    path = folder / "in.jsonl"
    path.write_text(json.dumps({"ordinal": 4, "video_id": "a", "tags": [],
                                "published_at": "2024-02-03T04:05:06"}) + "\n")
    return str(path)


def test_point_lookup_reaches_the_parquet_scan(spark, tmp_path):
    from talkgrain.operators import catalogue as C
    rows = SC.read_catalogue_lines(spark, _lines(tmp_path))
    SC.write_catalogue(rows, str(tmp_path / "v1"))
    found = C.episode_by_id(spark.read.parquet(str(tmp_path / "v1")), "a").select("title")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(video_id,a)" in plan
    assert "ReadSchema: struct<video_id:string,title:string>" in plan


def test_video_items(spark, tmp_path):
    item = {
        "id": "v1",
        "snippet": {"title": "T", "description": "D", "publishedAt": "2024-02-03T04:05:06Z",
                    "channelId": "c", "channelTitle": "C", "resourceId": {"videoId": "v1"},
                    "thumbnails": {"high": {"url": "u"}}},
        "contentDetails": {"duration": "PT5M"},
        "statistics": {"likeCount": "7"},
    }
    path = tmp_path / "items.jsonl"
    path.write_text(json.dumps(item) + "\n")
    items = SC.read_video_items(spark, str(path))
    r = SC.episodes_from_items(items).first()
    assert (r.video_id, r.view_count, r.like_count, r.comment_count, r.tags, r.thumbnail_url) == (
        "v1", 0, 7, None, [], "u")
    assert r.published_at.isoformat() == "2024-02-03T04:05:06"
    assert SC.playlist_video_ids(items).first().video_id == "v1"


def test_inventory_reads_no_contents(spark, landed):
    files = SC.read_inventory(spark, landed)
    assert sorted(r.file_name for r in files.collect()) == [
        "bad.json", "notes.txt", "one.json", "two.json"]
    assert "content" not in files.columns


def test_readable_files_keep_line_order(spark, tmp_path):
    lines = [("v1", i - 3, f"line {i}") for i in range(20)] + [("v2", 0, "x")]
    frame = spark.createDataFrame(lines, "video_id string, line_no bigint, line string")
    ST.write_readable(frame.repartition(5), str(tmp_path / "out"))
    folder = tmp_path / "out" / "video_id=v1" / "part=0"
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert text == "".join(f"line {i}\n" for i in range(20))
    again = ST.read_readable(spark, str(tmp_path / "out"))
    assert sorted((r.video_id, r.line) for r in again.collect()) == sorted(
        (v, x) for v, _, x in lines)


def test_chunk_files(spark, landed, tmp_path):
    files = ST.accepted(ST.read_transcripts(spark, landed).cache())
    nobody = SC.read_catalogue(spark, landed).drop("ordinal").where("false")
    rows = K.document_chunk_rows(K.readable_documents(files), nobody)
    chunks = K.chunk_documents(rows)
    ST.write_chunks(chunks, str(tmp_path / "out"))
    again = ST.read_chunks(spark, str(tmp_path / "out"))
    assert again.schema.simpleString() == chunks.schema.simpleString()
    ST.write_chunks(chunks, str(tmp_path / "months"), by="month")
    assert (tmp_path / "months" / "year=2024" / "month=2").is_dir()
    months = ST.read_chunks(spark, str(tmp_path / "months"))
    assert sorted(map(str, months.collect())) == sorted(map(str, again.collect()))
    got = again.orderBy("chunk_index").collect()
    assert [r.chunk_id for r in got] == ["one_0", "one_1"]
    assert (got[0].metadata.year, got[0].metadata.confidence_tier, got[0].episode_type) == (
        2024, "high", "UNKNOWN")
    assert got[0].context.next == "b" and got[0].metadata.has_tags is False


def test_bad_items_and_lines_make_no_rows(spark, tmp_path):
    items = SC.parse_video_items(spark.createDataFrame([
        ('{"id": "a", "statistics": {"viewCount": "", "likeCount": "many"}, "snippet": {"publishedAt": "?"}}',),
        ('{"id": "b"',), ("{}",), (None,)], "item string"))
    got = SC.episodes_from_items(items).collect()
    assert [(r.video_id, r.view_count, r.like_count, r.published_at) for r in got] == [("a", 0, None, None)]
    assert [r._corrupt_record for r in SC.unreadable(items).collect()] == ['{"id": "b"']
    path = tmp_path / "lines.json"
    path.write_text('{"video_id": "x", "published_at": "soon"}\n{"video_id": "y"\n')
    assert [(r.video_id, r.published_at) for r in SC.read_catalogue_lines(spark, str(path)).collect()] == [("x", None)]
    assert SC.unreadable(SC.read_lines(spark, str(path)).cache()).count() == 1


def test_documents_are_named_by_their_file(spark):
    episodes = spark.createDataFrame([("v1", "v1.json"), ("v2", "")], "video_id string, transcript_filename string")
    landed = ST.parse_transcripts(spark.createDataFrame([
        ("v1.json", '{"results": {"utterances": [{"transcript": "t"}]}}'),
        ("z.json", '{"results": {"utterances": [{"transcript": "u"}]}, "episode_metadata": {"video_id": "own"}}'),
        ("w.json", '{"results": {"utterances": [{"transcript": "w"}]}}')], "file_name string, document string"))
    rows = ST.utterances(ST.name_by_file(landed, episodes)).collect()
    assert sorted((r.transcript, r.video_id) for r in rows) == [("t", "v1"), ("u", "own"), ("w", None)]


def tasks_of(spark, group, run):
    """What ``run`` gives, and the numbers of tasks of the stages it starts."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        got = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    return got, [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]


@pytest.mark.parametrize("kind", ["inventory", "transcripts"])
def test_many_folders_are_listed_by_few_tasks(spark, tmp_path, kind):
    for i in range(150):
        (tmp_path / f"file_name={i}.json").mkdir()
        (tmp_path / f"file_name={i}.json" / "part-0.txt").write_text("{" if i % 50 == 0 else '{"results": {"duration": 5.0}}')
    held = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    read = {"inventory": lambda: SC.read_inventory(spark, str(tmp_path)),
            "transcripts": lambda: ST.read_transcripts(spark, str(tmp_path), names="part-*")}[kind]
    files, tasks = tasks_of(spark, f"list-{kind}", read)
    assert tasks and max(tasks) <= 32
    assert files.count() == 150
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == held


def test_a_table_in_one_file_is_landed_by_many_tasks(spark, tmp_path):
    rows = [(i % 90, i // 90, "system" if i % 7 == 0 else "user", f"line {i}\nmore") for i in range(400)]
    twice = [*rows, *rows[:20], (None, 1, "user", "no id"), (None, 2, "user", "no id either")]
    table = spark.createDataFrame(twice, T.SCHEMAS["conversations"]).coalesce(1)
    spread = T.spread_turns(table)
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    homes = T.documents_of(spread).withColumn("task", F.spark_partition_id()).groupBy("file_name").agg(
        F.count_distinct("task").alias("n"))
    assert {r["n"] for r in homes.collect()} == {1}
    want, got = (sorted(map(str, T.documents_of(t).collect())) for t in (table, spread))
    assert got == want
