"""Catalogue documents ``{"episodes": [...]}`` of any size, read by as many tasks as a file has splits.

Spark's text reader cuts a file at closing braces, so a split is a run of whole pieces, and no piece
is cut by a border between splits. Two passes over the pieces follow:

1. Each split tells how it changes the state of the reader, once for a start outside of a string and
   once for a start inside: nesting depth, whether a string is open, which ``"episodes": [`` are open.
   The few rows of a file, one for each split, are folded in order, which gives the true state at the
   start of each split, and whether the document is balanced as a whole.
2. Each split, now with its state, gives the text of its elements. Only an element that crosses a
   border is put together from its parts.

Cases: a document that is not balanced, or ends early, has no rows, like an empty one; an element that
is balanced but not JSON keeps its text in ``_corrupt_record``, and the other elements stay; what is no
object inside the array is passed over and not counted; arrays of other names, and of that name further inside, are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgrain import schemas
from talkgrain.plans.scratch import stored
from talkgrain.plans.ship import ship_package
from talkgrain.sources.catalogue import readable, typed_episodes

_STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
#: The next bracket outside of strings, or the quote of a string that does not end in the piece.
_MARK = re.compile(r'(?:[^"{\[\]]++|"(?:[^"\\]++|\\.)*+")*+(["{\[\]])', re.S)
_NAMED = re.compile(r'(?<!\\)"episodes"\s*:\s*\Z')
_PLACE = "path string, start bigint, "


class _Reader:
    """The state of a scan over pieces; ``depth`` counts open braces and brackets."""

    def __init__(self, depth: int, inside: bool, arrays: list[int]):
        self.depth, self.inside, self.arrays = depth, inside, arrays
        self.least = depth

    def read(self, piece: str) -> Iterator[tuple[int, str]]:
        """Go over a piece and the brace after it; gives (position, mark) with the state after it."""
        at = 0
        if self.inside:
            end = _STRING_END.match(piece)
            if not end:
                return
            self.inside, at = False, end.end()
        while mark := _MARK.match(piece, at):
            kind, at = mark[1], mark.end()
            if kind == '"':
                self.inside = True
                return
            if kind == "]":
                self.down()
            else:
                if kind == "[" and _NAMED.search(piece[max(0, at - 65):at - 1]):
                    self.arrays.append(self.depth)
                self.depth += 1
            yield at - 1, kind
        self.down()
        yield len(piece), "}"

    def down(self) -> None:
        self.depth -= 1
        self.least = min(self.least, self.depth)
        while self.arrays and self.arrays[-1] >= self.depth:
            self.arrays.pop()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, list]]:
    """(place, whether it begins, rows) of each run of rows of one split."""
    place = None
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        a = 0
        for b in range(1, len(rows) + 1):
            if b == len(rows) or rows[b][:2] != rows[a][:2]:
                yield rows[a][:2], rows[a][:2] != place, rows[a:b]
                place, a = rows[a][:2], b


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: what it does to a reader that starts outside or inside of a string."""
    def told(place, whole, size, readers):
        return pa.RecordBatch.from_pylist([{
            "path": place[0], "start": place[1], "whole": whole, "size": size,
            "depth": [r.depth for r in readers], "least": [r.least for r in readers],
            "inside": [r.inside for r in readers], "arrays": [r.arrays for r in readers]}], _CHANGES)

    readers, at, whole, size = None, None, 0, 0
    for place, begins, rows in _runs(batches):
        if begins:
            if readers:
                yield told(at, whole, size, readers)
            readers, at, whole, size = [_Reader(0, False, []), _Reader(0, True, [])], place, rows[0][2], 0
        for row in rows:
            size += len(row[3].encode()) + 1
            for reader in readers:
                for _ in reader.read(row[3]):
                    pass
    if readers:
        yield told(at, whole, size, readers)


_CHANGES = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("whole", pa.int64()), ("size", pa.int64()),
    *((c, pa.list_(pa.int64())) for c in ("depth", "least")), ("inside", pa.list_(pa.bool_())),
    ("arrays", pa.list_(pa.list_(pa.int64())))])


def _states(splits: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each split of one file; no rows if the document is not balanced."""
    splits = splits.sort_values("start")
    depth, inside, reading, out = 0, False, False, []
    for row in splits.itertuples():
        out.append((row.path, row.start, depth, inside, reading))
        way = int(inside)
        if depth + row.least[way] <= 1:
            reading = False
        reading |= any(depth + opened == 1 for opened in row.arrays[way])
        depth, inside = depth + int(row.depth[way]), bool(row.inside[way])
    # The reader gives a last piece no sign of whether a brace follows; the size of the file tells.
    if not inside and splits["size"].sum() == splits["whole"].iloc[0] + 1:
        depth += 1
    balanced = depth == 0 and not inside
    return pd.DataFrame(out if balanced else [], columns=["path", "start", "depth", "inside", "reading"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, seq, whole, value): elements, and parts of those that cross a border; ``seq``
    counts the elements that begin in the split, from 0; -1: it began before."""
    reader = at = None
    seq, kept, began, out = -1, None, True, []

    def flush():
        rows = [dict(zip(_ELEMENTS.names, row, strict=True)) for row in out]
        out.clear()
        return pa.RecordBatch.from_pylist(rows, _ELEMENTS)

    for place, begins, rows in _runs(batches):
        if begins:
            if kept:
                out.append((*at, seq, False, "".join(kept)))
            depth, inside, reading = rows[0][3:]
            reader, at, seq = _Reader(depth, inside, [1] if reading else []), place, -1
            kept, began = ([], False) if reading and depth > 2 else (None, True)
        for row in rows:
            piece, taken = row[2], 0
            for position, mark in reader.read(piece):
                if mark == "{" and reader.depth == 3 and reader.arrays[:1] == [1]:
                    seq, kept, began, taken = seq + 1, [], True, position
                elif mark == "}" and reader.depth == 2 and kept is not None:
                    kept.append(piece[taken:] + "}")
                    out.append((*at, seq, began, "".join(kept)))
                    kept = None
                elif mark == "]" and reader.depth == 2:
                    kept = None
            if kept is not None:
                kept.append(piece[taken:] + "}")
        if out:
            yield flush()
    if kept:
        out.append((*at, seq, False, "".join(kept)))
        yield flush()


_ELEMENTS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("seq", pa.int64()),
                       ("whole", pa.bool_()), ("value", pa.string())])


def catalogue_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, value): the text of every element of the documents, with its place in its own."""
    ship_package(spark)
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("whole"), "value")
    changes = pieces.mapInArrow(_changes, _PLACE + (
        "whole bigint, size bigint, depth array<bigint>, least array<bigint>, inside array<boolean>,"
        " arrays array<array<bigint>>"))
    states = stored(changes.groupBy("path").applyInPandas(
        _states, _PLACE + "depth bigint, inside boolean, reading boolean"), "document-states")
    # One row for each split, a few bytes for 128 MB of text.
    stated = pieces.join(F.broadcast(states), ["path", "start"]).select(
        "path", "start", "value", "depth", "inside", "reading")
    parts = stored(stated.mapInArrow(
        _elements, _PLACE + "seq bigint, whole boolean, value string"), "document-elements")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy("path", "start").agg((F.max("seq") + 1).alias("n")).select(
        "path", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = parts.join(F.broadcast(first), ["path", "start"]).select(
        "path", (F.col("before") + F.col("seq")).alias("ordinal"), "start", "whole", "value")
    crossing = placed.where("not whole").groupBy("path", "ordinal").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), "").alias("value"))
    return placed.where("whole").select("path", "ordinal", "value").unionByName(crossing)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows of catalogue documents with their ``ordinal``; what is not JSON is in ``_corrupt_record``."""
    row = schemas.struct_type(f"{schemas.EPISODE_FILE_DDL}, _corrupt_record: string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return catalogue_elements(spark, path).select(
        "ordinal", F.inline(F.array(F.from_json("value", row, options))))


def read_large_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`talkgrain.sources.catalogue.read_catalogue`, one file read by many tasks."""
    return typed_episodes(readable(read_documents(spark, path)))
