import random

import pytest

from pyspark.sql import functions as F

from talkgrain import schemas
from talkgrain.operators import turns as U
from talkgrain.plans import blocks
from talkgrain.sources.catalogue import typed_episodes

WORDS = (
    "video_id string, pos bigint, speaker int, start double, word string, punctuated_word string"
)


def words(video, speakers, start=0.5):
    return [
        (video, i, s, i * start, f"w{i}", None if i % 4 == 1 else f"W{i}.")
        for i, s in enumerate(speakers)
    ]


def runs(rows):
    out = []
    for video, pos, speaker, start, word, punctuated in sorted(rows, key=lambda r: (r[0], r[1])):
        text = punctuated if punctuated is not None else word
        if out and out[-1][0] == video and out[-1][2] == speaker:
            out[-1][4].append(text)
        else:
            out.append([video, pos, speaker, start, [text]])
    return sorted((v, p, -1 if s is None else s, t, " ".join(x)) for v, p, s, t, x in out)


@pytest.mark.parametrize("block_rows", [1, 5, 64, 1 << 16])
def test_turns(spark, block_rows):
    rng = random.Random(block_rows)
    rows = (
        words("aba", [0, 1, 0]) + words("one", [3]) + words("null", [None, None, 0, None])
        + words("monologue", [0] * 130)
        + words("mixed", [rng.choice([0, 0, 0, 1, None]) for _ in range(200)])
    )
    rng.shuffle(rows)
    got = U.speaker_turns(
        spark.createDataFrame(rows, WORDS), block_rows=block_rows
    ).collect()
    assert sorted((r.video_id, r.turn_pos, -1 if r.speaker is None else r.speaker, r.start, r.text)
                  for r in got) == runs(rows)


def test_an_endless_turn_is_one_row(spark):
    rows = words("long", [0] * 100 + [1] * 3)
    got = U.speaker_turns(spark.createDataFrame(rows, WORDS), block_rows=2).orderBy("turn_pos").collect()
    assert [(r.turn_pos, r.words) for r in got] == [(0, 100), (100, 3)]
    assert sorted(r.text for r in got) == sorted(x[4] for x in runs(rows))


def test_turns_in_documents(spark):
    rng = random.Random(8)
    rows = words("a", [rng.choice([0, 0, 1, None]) for _ in range(60)]) + words("b", [2])
    table = spark.createDataFrame(rows, WORDS)
    item = F.struct("word", "punctuated_word", "start", "speaker")
    documents = table.groupBy("video_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("w")))), lambda x: x["w"])
        .alias("words")).select(
        F.struct(F.array(F.struct(F.array(F.struct("words")).alias("alternatives"))).alias("channels"))
        .alias("results"), F.struct("video_id").alias("episode_metadata"))
    empty = documents.withColumn("results", F.struct(F.filter("results.channels", lambda c: F.lit(False))
                                                     .alias("channels")))
    got = U.turns_in_document(documents.unionByName(empty))
    assert "Exchange" not in U.turns_in_document(
        spark.createDataFrame([], documents.schema))._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.video_id, r.turn_pos, -1 if r.speaker is None else r.speaker, r.start, r.text)
                  for r in got.collect()) == runs(rows)


def test_a_speaker_listed_twice_has_one_name(spark):
    names = spark.createDataFrame([("v", 0, "Al"), ("v", 0, "Bo"), ("v", 1, None)],
                                  "video_id string, speaker int, name string")
    assert U.names_by_video(names).first().names == {0: "Bo"}


def episode(**fields):
    row = {
        "video_id": "v", "title": "T", "published_at": "2024-03-05T10:00:00",
        "duration": "PT1H", "transcript_filename": "v.json", "transcript_duration": 1234.5,
        "metadata": {"duration_seconds": 3600, "transcript_coverage": 34.29},
    }
    return row | fields


def episodes(spark, *rows):
    schema = schemas.struct_type(schemas.EPISODE_FILE_DDL)
    return typed_episodes(spark.createDataFrame(list(rows), schema))


def test_readable_transcript(spark):
    rows = words("v", [0, 0, 1, None]) + words("unknown", [0])
    speakers = spark.createDataFrame([("v", 0, "Ann")], "video_id string, speaker int, name string")
    found = U.readable_transcript(
        episodes(
            spark, episode(),
            episode(video_id="silent", metadata={}, transcript_duration=None),
            episode(video_id="none", transcript_filename=""),
        ),
        spark.createDataFrame(rows, WORDS), speakers, block_rows=2,
    )
    lines = {}
    for r in found.orderBy("video_id", "line_no").collect():
        lines.setdefault(r.video_id, []).append(r.line)
    assert lines == {
        "v": [
            "# T", "Video ID: v", "Published: 2024-03-05", "Duration: PT1H (3600 seconds)",
            "Transcript Duration: 1,234.50 seconds".replace(",", ""), "Coverage: 34.29%",
            "", "=" * 80, "",
            "[0.0] Ann: W0. w1", "[1.0] Speaker 1: W2.", "[1.5] Speaker None: W3.",
        ],
        "silent": ["# T", "Video ID: silent", "Published: 2024-03-05", "", "=" * 80, "",
                   "No transcript data found"],
    }


def test_names_fall_back(spark):
    rows = spark.createDataFrame(words("v", [0, 1]), WORDS)
    names = U.names_by_video(spark.createDataFrame(
        [("v", 1, "Bob"), ("v", 0, None)], "video_id string, speaker int, name string"))
    turns = U.name_turns(U.speaker_turns(rows), names, blocks.lengths_of(rows, "video_id", "pos"))
    assert [r.name for r in turns.orderBy("turn_pos").collect()] == ["Speaker 0", "Bob"]
