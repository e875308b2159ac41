import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from talkgrain.operators import catalogue as C
from talkgrain.plans import queries as PQ
from talkgrain.plans import tables as T
from talkgrain.plans.queries import QUERIES
from talkgrain.sources import catalogue as SC
from talkgrain.sources import transcripts as ST
from talkgrain.streaming import incremental as I

COUNTS = ["day", "type", "episodes"]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def landed(spark, tmp_path):
    """Transcript documents landed as several files, read two per trigger."""
    path = str(tmp_path / "landed")
    documents = T.transcript_documents(spark, SMALL)
    documents.repartition(6, "file_name").write.parquet(path)
    return path


def test_chunk_stream_equals_batch(spark, landed, tmp_path):
    known = C.classify(T.document_episodes(spark, SMALL))
    batch = spark.read.parquet(landed)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    out = str(tmp_path / "out")
    run = (
        I.chunk_stream(stream, known).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    assert run.lastProgress.batchId >= 2
    want = I.chunk_stream(batch, known)
    assert rows(spark.read.parquet(out).select(want.columns)) == rows(want)
    assert want.count() > 0


def test_type_counts_complete_and_append(spark, tmp_path):
    path = str(tmp_path / "episodes")
    T.episodes(spark, SMALL).repartition(4).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    want = rows(I.type_counts_by_day(spark.read.parquet(path)).select(COUNTS))
    for mode in ("complete", "append"):
        seen = []
        def keep(batch, _id, seen=seen, mode=mode):
            if mode == "complete":
                seen.clear()
            seen.extend(batch.select(COUNTS).collect())
        (
            I.type_counts_by_day(stream).writeStream.outputMode(mode).foreachBatch(keep)
            .option("checkpointLocation", str(tmp_path / mode)).trigger(availableNow=True)
            .start().awaitTermination()
        )
        found = sorted(map(str, seen))
        assert found == want if mode == "complete" else set(found) < set(want)


def test_replayed_batches_leave_the_same_rows(spark, tmp_path):
    stored = T.catalogue(spark, SMALL).unionByName(T.catalogue(spark, SMALL).where("video_id < '2'"))
    SC.write_catalogue(stored, str(tmp_path / "base"))
    updates = T.updates(spark, SMALL)
    updates.repartition(3, "video_id").write.parquet(str(tmp_path / "landed"))
    stream = (
        spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "landed"))
    )

    def run(progress):
        query = (I.append_batches(stream, str(tmp_path / "batches"))
                 .option("checkpointLocation", str(tmp_path / progress)).trigger(availableNow=True).start())
        query.awaitTermination()
        return rows(I.upserted(spark.read.parquet(str(tmp_path / "base")),
                               spark.read.parquet(str(tmp_path / "batches"))).select(ids))

    ids = ["video_id", "title", "duration"]
    want = rows(C.upsert(stored.withColumn("ordinal", F.lit(0).cast("bigint")), updates).select(ids))
    assert run("progress") == want
    sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / "batches").glob("batch=*")]
    assert len(sizes) > 1 and sum(sizes) == updates.select("video_id").distinct().count()
    assert run("progress-lost") == want
    I.fold_batches(spark.read.parquet(str(tmp_path / "base")), spark.read.parquet(str(tmp_path / "batches")),
                   str(tmp_path / "next"))
    assert rows(spark.read.parquet(str(tmp_path / "next")).select(ids)) == want


def test_rejects_are_named(spark, landed):
    found = I.rejected_stream(spark.read.parquet(landed))
    reasons = {r.reason for r in found.collect()}
    assert reasons == {"not JSON", "no episode metadata", "unreadable date"}


def test_a_document_that_lands_again_is_chunked_once_and_bad_ones_are_named(spark, tmp_path):
    documents = {r["file_name"]: r["document"] for r in T.transcript_documents(spark, SMALL).collect()}
    broken = {n for n in documents if n.endswith("-broken.json")}
    folder = tmp_path / "landed"
    for turn in ("first", "second"):
        (folder / turn).mkdir(parents=True)
        for k, (name, text) in enumerate(sorted(documents.items())):
            if turn == "first" or k % 2:
                (folder / turn / name).write_text(text)
    whole = next(n for n in sorted(documents) if n not in broken)
    (folder / "third").mkdir()
    (folder / "third" / whole).write_text("{")  # the same name with another text is another document
    known = C.classify(T.document_episodes(spark, SMALL))
    landed = I.once_each(ST.stream_documents(spark, str(folder), per_trigger=20))
    I.land(landed, known, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(
        availableNow=True).start().awaitTermination()
    want = I.chunk_stream(T.transcript_documents(spark, SMALL), known)
    assert rows(spark.read.parquet(str(tmp_path / "out/chunks")).select(want.columns)) == rows(want)
    bad = {(r["file_name"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()}
    assert {n for n, why in bad if why == "not JSON"} == broken | {whole}


def test_rejects_of_parsed_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"results": {"utterances": []}, "episode_metadata": null}')
    (tmp_path / "bad.json").write_text("{")
    parsed = ST.read_transcripts(spark, str(tmp_path))
    assert {r["file_name"]: r["reason"] for r in I.rejected_parsed(parsed).collect()} == {
        "bad.json": "not JSON", "good.json": "no episode metadata"}


def test_rows_that_differ_in_metadata_alone_are_told_apart(spark):
    base = C.classify(T.catalogue(spark, SMALL)).limit(1).withColumn("ordinal", F.lit(5).cast("bigint"))
    batches = base.unionByName(base.withColumn("metadata", F.col("metadata").withField("type", F.lit("other")))).withColumn(
        "batch", F.lit(1))
    got = {str(I.upserted(base.drop("ordinal"), batches.repartition(k, "metadata.type")).collect()) for k in (1, 2, 5)}
    got |= {str(I.upserted(base.drop("ordinal"), batches.orderBy(F.desc("metadata.type"))).collect())}
    assert len(got) == 1


@pytest.mark.parametrize("files", [0, 3])
def test_type_counts_of_a_table_in_one_file_or_in_a_folder(spark, tmp_path, files):
    table = spark.createDataFrame(
        [(i, f"text {i}", "en", "web", 50 * i) for i in range(60)] + [(None, "no id", "en", "web", 7)], T.SCHEMAS["documents"])
    (tmp_path / "t").mkdir()
    if files:
        table.repartition(files).write.parquet(str(tmp_path / "t/documents.parquet"))
    else:
        table.coalesce(1).write.parquet(str(tmp_path / "whole"))
        next((tmp_path / "whole").glob("part-*")).rename(tmp_path / "t/documents.parquet")
    want = I.type_counts_by_day(T.episodes(spark, str(tmp_path / "t"))).select(COUNTS)
    assert rows(QUERIES["stream_type_counts"](spark, str(tmp_path / "t")).select(COUNTS)) == rows(want)
    assert sum(r["episodes"] for r in want.collect()) == 60


def test_type_changes_of_a_catalogue_in_many_files_are_those_of_one(spark, monkeypatch):
    want = rows(QUERIES["stream_type_changes"](spark, SMALL).select(COUNTS))
    out = []
    kept = PQ.scratch_dir
    monkeypatch.setattr(PQ, "scratch_dir", lambda spark, name: out.append(kept(spark, name)) or out[-1])
    monkeypatch.setattr(PQ, "ROWS_PER_FILE", 60)
    assert rows(QUERIES["stream_type_changes"](spark, SMALL).select(COUNTS)) == want
    files = [spark.read.parquet(f"{out[0]}/landed/part={k}").inputFiles() for k in range(3)]
    assert [len(x) for x in files] == [3, 3, 3]


def test_the_last_row_of_a_video_is_found_among_nulls():
    found = [(1, None, "b"), (0, "z", "z"), (1, "a", None), (1, "a", "c"), (1, float("nan"), "z")]
    assert max(found, key=I._nulls_first) == (1, "a", "c")


def test_turns_are_spread_before_documents_are_built_of_them(spark, monkeypatch):
    out = []
    kept = PQ.scratch_dir
    monkeypatch.setattr(PQ, "scratch_dir", lambda spark, name: out.append(kept(spark, name)) or out[-1])
    monkeypatch.setattr(PQ.T, "transcript_documents", None)  # whole documents would move once more
    PQ._landed_twice(spark, SMALL)
    landed = spark.read.parquet(out[0])
    assert 1 < len(landed.inputFiles()) <= 12
    documents = T.documents_of(T.table(spark, SMALL, "conversations"))
    want = documents.unionByName(documents.where("xxhash64(file_name) % 3 = 0"))
    assert rows(landed.select(want.columns)) == rows(want)
