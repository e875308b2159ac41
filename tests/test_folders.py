"""Very many small files: written and listed by tasks, read many to a task."""

import os
import time

import pytest
from pyspark.sql import functions as F

from talkgrain.plans import queries as PQ
from talkgrain.plans import tables as T
from talkgrain.sources import catalogue as SC
from talkgrain.sources import folders
from talkgrain.sources import transcripts as ST


def contents(root):
    """Text of every folder, its visible files in order."""
    found = {}
    for at, _, names in os.walk(root):
        if texts := [open(f"{at}/{n}", "rb").read() for n in sorted(names) if n.startswith("part-")]:
            found[os.path.relpath(at, root)] = b"".join(texts)
    return found


ODD = [("a b", "one"), ("a b", "two"), ("x/y=%z'", "slash"), ("", "empty"), (None, "none"),
       (None, "again"), ("n\nl", None), ("t", "")]


def test_folders_are_those_of_the_writer_of_spark(spark, tmp_path):
    rows = spark.createDataFrame([(n, k % 2, v) for k, (n, v) in enumerate(ODD * 3)], "name string, k int, value string")
    rows = rows.withColumn("at", F.monotonically_increasing_id()).coalesce(1)
    folders.write_folders(rows, str(tmp_path / "own"), ("name", "k"), "value", ("at",))
    rows.drop("at").write.partitionBy("name", "k").text(str(tmp_path / "spark"))
    def lines(x):
        return {k: sorted(v.split(b"\n")) for k, v in contents(tmp_path / x).items()}

    assert lines("own") == lines("spark")
    assert contents(tmp_path / "own")["name=__HIVE_DEFAULT_PARTITION__/k=1"] == b"empty\nagain\n" * 3
    assert sorted(os.listdir(tmp_path)) == ["own", "spark"]
    schema = "value string, name string, k int"
    own, want = (sorted(map(str, spark.read.schema(schema).text(str(tmp_path / x)).collect())) for x in ("own", "spark"))
    assert own == want


def test_a_directory_is_not_overwritten_and_a_failure_leaves_none(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x")], "name string, value string")
    folders.write_folders(rows, str(tmp_path / "out"), ("name",), "value")
    with pytest.raises(Exception, match="(?i)already exists"):
        folders.write_folders(rows, str(tmp_path / "out"), ("name",), "value")
    failing = rows.withColumn("value", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        folders.write_folders(failing, str(tmp_path / "bad"), ("name",), "value")
    assert os.listdir(tmp_path) == ["out"]


def test_other_stores_are_written_by_spark(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, value string")
    monkeypatch.setattr(folders, "local_path", lambda *_: None)
    folders.write_folders(rows, str(tmp_path / "out"), ("name",), "value")
    assert contents(tmp_path / "out") == {"name=a": b"x\n", "name=b": b"y\n"}
    (tmp_path / "out" / ".hidden").write_text("h")
    assert {(r.file_name[:5], r.length) for r in SC.read_inventory(spark, str(tmp_path / "out")).collect()} == {("part-", 2)}


def test_a_long_folder_is_written_in_pieces(spark, tmp_path):
    rows = spark.range(40).select(F.lit("a").alias("name"), F.repeat(F.lit("z"), 1 << 20).alias("value")).coalesce(1)
    folders.write_folders(rows, str(tmp_path / "out"), ("name",), "value")
    (text,) = contents(tmp_path / "out").values()
    assert text == (b"z" * (1 << 20) + b"\n") * 40


def test_many_folders_take_little_time(spark, tmp_path):
    """A folder took Spark's writer some 20 ms of one task."""
    lines = spark.range(4000).select(
        F.col("id").cast("string").alias("video_id"), F.lit(0).cast("bigint").alias("line_no"), F.lit("x").alias("line"))
    began = time.perf_counter()
    ST.write_readable(lines, str(tmp_path / "out"))
    assert time.perf_counter() - began < 20
    assert ST.read_readable(spark, str(tmp_path / "out")).count() == 4000


def test_inventory_is_listed_by_tasks(spark, tmp_path):
    """The list is a table, of which the driver holds nothing; it has what Spark lists."""
    for i in range(60):
        (tmp_path / f"shelf={i % 40}" / f"file_name={i}.json").mkdir(parents=True)
        (tmp_path / f"shelf={i % 40}" / f"file_name={i}.json" / "part-0.txt").write_text("x" * i)
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "top.txt").write_text("top")
    (tmp_path / ".gone" / "below").mkdir(parents=True)
    (tmp_path / ".gone" / "below" / "f.txt").write_text("no")
    files = SC.read_inventory(spark, str(tmp_path))
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length")
    assert sorted(map(tuple, files.select("path", "length").collect())) == sorted(map(tuple, want.collect()))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "binaryFile" not in plan
    with pytest.raises(Exception, match="(?i)does not exist"):
        SC.read_inventory(spark, str(tmp_path / "nothing"))


def test_small_files_are_read_many_to_a_task(spark, tmp_path):
    rows = [(i, 0, "user", f"line {i}") for i in range(700)] + [(7, 0, "user", "line 7"), (None, 1, "user", "no id")]
    spark.createDataFrame(rows, T.SCHEMAS["conversations"]).write.parquet(str(tmp_path / "conversations.parquet"))
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    context = spark.sparkContext
    context.setJobGroup("small files", "small files")
    try:
        got = PQ.QUERIES["transcript_files"](spark, str(tmp_path)).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.files.maxPartitionBytes", held["spark.sql.files.maxPartitionBytes"])
    assert {c: spark.conf.get(c) for c in held} == held
    assert sorted(r.file_name for r in got) == sorted(
        [f"{i}-0.json" for i in range(700)] + ["__HIVE_DEFAULT_PARTITION__"])
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("small files")]
    # 701 files were 176 tasks, four files of 4 MB each.
    assert max(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds) <= 64
