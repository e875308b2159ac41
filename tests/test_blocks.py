"""Block-wise ordered primitives against plain windows over whole sequences."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrain.plans import blocks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for video, n in (("hot", 400), ("b", 17), ("c", 16), ("d", 1)):
        speaker = 0
        for pos in range(n):
            if rng.random() < 0.1:
                speaker = rng.choice([0, 1, None])
            data.append((video, pos, speaker, rng.randint(0, 9)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "video_id string, pos bigint, speaker int, n int").cache()


def order():
    return Window.partitionBy("video_id").orderBy("pos")


def same(left, right):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, left.collect()), key=key) == sorted(
        map(tuple, right.collect()), key=key)


@pytest.mark.parametrize("size", [1, 2, 8, 16, 1000])
def test_neighbours(rows, size):
    got = blocks.with_neighbours(
        rows, "video_id", "pos", previous={"p": "n"}, following={"f": "n"}, size=size
    ).select("video_id", "pos", "p", "f")
    want = rows.select("video_id", "pos", F.lag("n").over(order()).alias("p"),
                       F.lead("n").over(order()).alias("f"))
    same(got, want)


@pytest.mark.parametrize("size", [1, 7, 16, 1000])
def test_running_totals(rows, size):
    blocked = rows.withColumn("block", blocks.block_of("pos", size))
    got = blocks.with_running_totals(
        blocked, "video_id", "block", ("pos",), {"before": F.col("n"), "rank": F.lit(1)}
    ).select("video_id", "pos", "before", "rank")
    earlier = order().rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "video_id", "pos", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), "pos"
    )
    same(got, want)


@pytest.mark.parametrize("size", [1, 7, 16, 1000])
def test_run_start(rows, size):
    near = blocks.with_neighbours(
        rows, "video_id", "pos", previous={"s": "speaker", "p": "pos"}, size=size
    ).withColumn("starts", F.expr("p is null or not (s <=> speaker)"))
    got = blocks.with_run_start(near, "video_id", "pos", "starts").select(
        "video_id", "pos", "run_start")
    flagged = rows.withColumn("s", F.lag("speaker").over(order())).withColumn(
        "p", F.lag("pos").over(order()))
    opened = F.when(F.expr("p is null or not (s <=> speaker)"), F.col("pos"))
    want = flagged.select("video_id", "pos", F.max(opened).over(order()).alias("run_start"))
    same(got, want)


def test_attach_by_block(spark, rows):
    small = spark.createDataFrame([("hot", "H"), ("b", "B"), ("zz", "Z")], "video_id string, t string")
    blocked = rows.withColumn("block", blocks.block_of("pos", 16))
    in_use = blocks.blocks_in_use(blocks.lengths_of(rows, "video_id", "pos"), "video_id", size=16)
    got = blocks.attach_by_block(blocked, small, in_use, "video_id").select("video_id", "pos", "t")
    same(got, rows.join(small, "video_id", "left").select("video_id", "pos", "t"))
