"""Very many small files in folders of their own, on a file system that tasks reach by plain paths.

Hadoop's local file system, without its native library, starts a process for every file and folder that it
makes (some 20 ms), and the driver holds the status of every file that Spark lists. On a path of the scheme
``file`` tasks write and list by themselves; other stores go through Spark.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.plans.scratch import stored
from talkgrain.sources.listing import most_tasks


def local_path(spark: SparkSession, directory: str) -> str | None:
    """The plain path of a directory whose scheme is ``file``, stated or by default; else None."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_folders(
    rows: DataFrame, directory: str, folders: Sequence[str], text: str, order: Sequence[str] = ()
) -> None:
    """Write the column ``text`` of ``rows`` as lines into folders ``name=value/...`` of the columns ``folders``, as
    ``partitionBy(...).text(...)`` does; a task sorts its rows of a folder by the columns ``order``.

    Files of an attempt appear whole, under the number of their task, so one that runs twice leaves the same
    files; the directory appears once all are written.
    """
    spark = rows.sparkSession
    place = local_path(spark, directory)
    if place is None or os.path.lexists(place):
        rows.sortWithinPartitions(*folders, *order).select(*folders, text).write.mode("errorifexists").partitionBy(
            *folders).text(directory)
        return
    # An empty name and an absent one have the same folder, so they have to lie side by side.
    ordered = rows.withColumns({c: F.expr(f"nullif(cast({c} as string), '')") for c in folders}).sortWithinPartitions(
        *folders, *order).select(*folders, text)
    parent, name = os.path.split(place.rstrip("/"))
    pending = os.path.join(parent, f".{name}-{uuid.uuid4().hex}")
    os.makedirs(pending)
    try:
        ordered.mapInArrow(_writer(pending, tuple(folders)), "files bigint").write.format("noop").mode(
            "overwrite").save()
        with open(os.path.join(pending, "_SUCCESS"), "wb"):
            pass
        os.rename(pending, place)
    except BaseException:
        shutil.rmtree(pending, ignore_errors=True)
        raise


def _writer(directory: str, names: tuple[str, ...]):
    """Task function. It refers to nothing of this package, so executors need no copy."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import re

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        file = f"part-{task.partitionId():05d}.txt"
        begun = f".{file}-{task.taskAttemptId()}"
        odd = re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")

        def folder(values: tuple) -> str:
            return os.path.join(directory, *(
                f"{n}={odd.sub(lambda m: f'%{ord(m[0]):02X}', v) if v else '__HIVE_DEFAULT_PARTITION__'}"
                for n, v in zip(names, values, strict=True)))

        def put(values: tuple, lines: list) -> None:
            to = folder(values)
            os.makedirs(to, exist_ok=True)
            with open(os.path.join(to, begun), "ab") as f:
                f.writelines(lines)
            lines.clear()

        def close(values: tuple, lines: list) -> None:
            put(values, lines)
            os.replace(os.path.join(folder(values), begun), os.path.join(folder(values), file))

        at, kept, size, files = None, [], 0, 0

        for batch in batches:
            places = zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            for values, value in zip(places, texts, strict=True):
                if values != at:
                    if at is not None:
                        close(at, kept)
                    at, size, files = values, 0, files + 1
                line = (value.as_py() or b"") + b"\n"
                kept.append(line)
                size += len(line)
                if size > 1 << 24:
                    put(at, kept)
                    size = 0
        if at is not None:
            close(at, kept)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    return write


def listed(spark: SparkSession, directory: str) -> DataFrame | None:
    """(path, length) of the files below a local directory, hidden and empty ones left out as Spark does; None
    where it is no local directory. Tasks list the folders; the list is stored when this is called."""
    place = local_path(spark, directory)
    if place is None or not os.path.isdir(place):
        return None
    tasks = most_tasks(spark)
    # Down to as many folders as there are tasks, or to the last ones; files above them are rows of their own.
    level, above = [place], []
    while level and len(level) < tasks:
        below = []
        for found in level:
            with os.scandir(found) as entries:
                for e in entries:
                    (below if e.is_dir() else above).append(e.path)
        level = below
    starts = spark.sparkContext.parallelize(
        [(p, place) for p in [*level, *above]], max(1, min(tasks, len(level) + len(above)))).toDF(
        "start string, top string")
    return stored(starts.mapInArrow(_walk(), "path string, length bigint"), "inventory-list")


def _walk():
    """Task function. It refers to nothing of this package, so executors need no copy."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import pyarrow as pa

        def hidden(name: str) -> bool:
            if name.startswith(("_common_metadata", "_metadata")):
                return False
            return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")

        def counts(name: str, size: int) -> bool:
            return size > 0 and not (name.startswith("_") and "=" not in name)

        def below(path: str):
            folders = [path]
            while folders:
                with os.scandir(folders.pop()) as entries:
                    for e in entries:
                        if hidden(e.name):
                            continue
                        if e.is_dir():
                            folders.append(e.path)
                        elif counts(e.name, size := e.stat().st_size):
                            yield e.path, size

        def rows(found: list) -> pa.RecordBatch:
            paths, sizes = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array([f"file:{p}" for p in paths], pa.string()), pa.array(sizes, pa.int64())],
                ["path", "length"])

        for batch in batches:
            for start, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if any(hidden(n) for n in os.path.relpath(start, top).split("/") if n != "."):
                    continue
                if not os.path.isdir(start):
                    size = os.stat(start).st_size
                    yield rows([(start, size)] if counts(os.path.basename(start), size) else [])
                    continue
                found = []
                for row in below(start):
                    found.append(row)
                    if len(found) == 10_000:
                        yield rows(found)
                        found = []
                yield rows(found)

    return walk
