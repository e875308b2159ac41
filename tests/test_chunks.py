import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkgrain.operators import chunks as K

DDL = (
    "video_id string, pos bigint, speaker int, transcript string, start double, end double,"
    " confidence double, speaker_confidence double"
)


def transcript(video, texts, speakers):
    return [
        (video, i, s, t, float(i), i + 0.5, (i * 37 % 100) / 100, None if i % 3 else 0.5)
        for i, (t, s) in enumerate(zip(texts, speakers, strict=True))
    ]


def greedy(rows, max_chars):
    """Sequential restatement: one pass over the rows of each recording in order."""
    out = []
    current = None
    for video, _pos, speaker, text, _start, _end, confidence, _sc in sorted(
            rows, key=lambda r: (r[0], r[1])):
        fits = (
            current is not None and current[0] == video and current[2] == speaker
            and len(current[3]) + len(text) <= max_chars
        )
        if fits:
            current[3] += " " + text
            current[4] = (current[4] + confidence) / 2
        else:
            if current:
                out.append(tuple(current))
            current = [video, _pos, speaker, text, confidence]
    return out + ([tuple(current)] if current else [])


def merged(spark, rows, max_chars, with_context=False, **sizes):
    frame = spark.createDataFrame(rows, DDL)
    got = K.merge_short_chunks(
        K.with_context(frame, block_rows=16) if with_context else frame, max_chars, **sizes)
    return sorted(
        (r.video_id, r.pos, r.speaker, r.transcript, r.confidence) for r in got.collect()
    )


def test_context(spark):
    rows = transcript("a", ["x" * 101, "mid", "end"], [0, 0, 1]) + transcript("b", ["only"], [0])
    for size in (1, 2, 100):
        got = K.with_context(spark.createDataFrame(rows, DDL), block_rows=size)
        seen = {(r.video_id, r.pos): (r.previous, r.next) for r in got.collect()}
        assert seen == {
            ("a", 0): ("", "mid"), ("a", 1): ("x" * 100 + "...", "end"), ("a", 2): ("mid", ""),
            ("b", 0): ("", ""),
        }


def test_merge_limits(spark):
    fits = transcript("fits", ["a" * 256, "b" * 256], [0, 0])
    over = transcript("over", ["a" * 256, "b" * 257], [0, 0])
    turns = transcript("turns", ["a", "b", "c", "d"], [0, 0, 1, 0])
    got = merged(spark, fits + over + turns, 512)
    assert [(v, p, len(t)) for v, p, _, t, _ in got] == [
        ("fits", 0, 513), ("over", 0, 256), ("over", 1, 257),
        ("turns", 0, 3), ("turns", 2, 1), ("turns", 3, 1)]


def test_merge_keeps_first_and_last_fields(spark):
    rows = transcript("v", ["a", "b", "c"], [0, 0, 0])
    chunks = K.with_context(spark.createDataFrame(rows, DDL))
    r = K.merge_short_chunks(chunks).collect()[0]
    assert (r.pos, r.start, r.end, r.transcript) == (0, 0.0, 2.5, "a b c")
    assert r.confidence == ((0.0 + 0.37) / 2 + 0.74) / 2
    assert (r.speaker_confidence, r.previous, r.next) == (0.5, "", "")


@pytest.mark.parametrize("maps_per_group,block_rows", [(1, 24), (3, 128), (4096, 1 << 16)])
def test_merge_of_long_recordings(spark, maps_per_group, block_rows):
    """Recordings of many fold blocks, among them one speaker repeating one text."""
    rng = random.Random(maps_per_group)
    n = 2000
    rows = (
        transcript("copies", ["yes"] * n, [0] * n)
        + transcript("empty", [""] * 300, [0] * 300)
        + transcript("one speaker", ["w" * rng.randint(0, 9) for _ in range(n)], [0] * n)
        + transcript("two", ["w" * rng.randint(0, 9) for _ in range(n)],
                     [int(rng.random() < 0.02) for _ in range(n)])
        + transcript("exact", ["ab"] * 96, [1] * 96)
        + transcript("big", ["z" * rng.choice([1, 40]) for _ in range(500)], [0] * 500)
    )
    for max_chars, fold_rows in ((20, 24), (30, 64)):
        got = merged(
            spark, rows, max_chars, with_context=block_rows == 128, fold_rows=fold_rows,
            block_rows=block_rows, maps_per_group=maps_per_group,
        )
        assert got == sorted(greedy(rows, max_chars))


def test_merge_carries_context_over_block_edges(spark):
    n = 200
    rows = transcript("v", [f"t{i}" for i in range(n)], [0] * n)
    frame = spark.createDataFrame(rows, DDL)
    got = K.merge_short_chunks(frame, 20, fold_rows=24, block_rows=48).orderBy("pos").collect()
    starts = [r.pos for r in got] + [n]
    assert [r.previous for r in got] == ["" if p == 0 else f"t{p - 1}" for p in starts[:-1]]
    assert [r.next for r in got] == ["" if p == n else f"t{p}" for p in starts[1:]]
    assert [r.end for r in got] == [p - 0.5 for p in starts[1:]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), min_size=1, max_size=120))
def test_fold_maps_follow_the_greedy_chain(items):
    """Every entry of a fold's map, against merging row by row from that offset."""
    import numpy as np
    import pyarrow as pa

    max_chars, size = 6, 8
    reach = max_chars + 2
    if len(items) < size:
        items = items * size
    items = items[: size + reach]
    lengths, speakers = [i[0] for i in items], [i[1] for i in items]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["v"]), pa.array([0]), pa.array([lengths], pa.list_(pa.int32())),
         pa.array([speakers], pa.list_(pa.int32()))],
        names=["video_id", "fold", "lengths", "speakers"],
    )
    got = next(K.fold_maps(max_chars, size, reach)(iter([batch]))).column("map")[0].as_py()
    for entry in range(min(reach, len(items))):
        i = entry
        while i < size:
            total, j = lengths[i], i + 1
            while j < len(items) and speakers[j] == speakers[i] and total + lengths[j] <= max_chars:
                total += 1 + lengths[j]
                j += 1
            i = j
        assert got[entry] == i - size
    assert np.all(np.asarray(got) >= 0)


@pytest.mark.parametrize("fold_rows", [1, 2048])
def test_merging_over_gaps(spark, fold_rows):
    """Rows are consecutive by order, whatever positions they have."""
    import random

    rng = random.Random(fold_rows)
    rows, pos = [], 0
    for i in range(400):
        pos += rng.choice([1, 1, 2, 5, 90])
        rows.append(("v", pos, rng.choice([0, 0, -1, None]), f"t{i}" * rng.randint(1, 4), float(i), i + 0.5,
                     0.5, None, "", ""))
    frame = spark.createDataFrame(
        rows, "video_id string, pos bigint, speaker int, transcript string, start double, `end` double,"
        " confidence double, speaker_confidence double, previous string, next string")
    want, at = [], None
    for r in rows:
        if at and at[2] == r[2] and len(at[3]) + len(r[3]) <= 20:
            at[3] += " " + r[3]
        else:
            at = list(r)
            want.append(at)
    merged = K.merge_short_chunks(frame, 20, block_rows=64, fold_rows=fold_rows, maps_per_group=2)
    assert [(r.pos, r.speaker, r.transcript) for r in merged.orderBy("pos").collect()] == [
        (w[1], w[2], w[3]) for w in want]
    again = K.merge_short_chunks(merged, 20)
    assert [r.transcript for r in again.orderBy("pos").collect()][:1] == [want[0][3]]


def test_rows_keep_their_own_title_and_date(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("known", 0, "Own"), ("unknown", 0, "Mine"), ("known", 1, None)],
                                 "video_id string, pos bigint, episode_title string").withColumn(
        "published_at", F.lit("2024-01-01").cast("timestamp"))
    known = spark.createDataFrame([("known", "Theirs")], "video_id string, title string").selectExpr(
        "*", "cast(null as timestamp) published_at", "'d' description", "array('t') tags", "1L view_count",
        "2L like_count", "3L comment_count", "named_struct('type', 'FULL', 'duration_seconds', 9L) metadata")
    got = K.enrich(rows, known).orderBy("video_id", "pos").collect()
    assert [r.episode_title for r in got] == ["Own", "Theirs", "Mine"]
    assert all(r.published_at is not None for r in got)
