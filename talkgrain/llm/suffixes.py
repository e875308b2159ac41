"""Exact byte-level deduplication by blockwise suffix sorting over a cover sample.

A byte goes if any ``length`` bytes around it also start anywhere else, in the same document or in
another. Suffixes are never sorted all at once. A cover holds ranks that settle long ties, one bucket
of suffixes at a time is ordered by what stands before its cover sample and by the sample's rank
(``talkgrain.llm.repeats``). The cover is drawn by content and not by position modulo a period: equal
windows then have a sample at one common distance, suffixes whose sample is unique need no bucket,
and a task holds the groups of a few samples only.

Cases: a null text is empty; texts shorter than ``length`` lose nothing; a text that several rows
have goes whole from all of them; null ids and repeated rows are rows of their own; an empty table
gives an empty table; other columns are carried along and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrain.llm.repeats import Windows, keyed, removed, with_runs

LENGTH = 200
SAMPLE = 64


def dedup_bytes(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE,
                with_text: bool = False, group_rows: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; ``with_text`` adds the kept
    text (characters cut by a removed run are left out) and ``rest``, the row's other columns."""
    spec = Windows(False, length, sample, **({"group_rows": group_rows} if group_rows else {}))
    rows = with_runs(keyed(docs), spec).select("doc_id", "text", "runs", "rest")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType())])
    if with_text:
        schema = schema.add("text", T.StringType()).add(rows.schema["rest"])
    else:
        rows = rows.drop("rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out, texts = [], []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = text.encode()
                    flags = removed(spec, runs, len(data))
                    gone = spans = 0
                    if flags is not None:
                        gone = int(flags.sum())
                        spans = int(flags[0]) + int((flags[1:] & ~flags[:-1]).sum())
                        data = np.frombuffer(data, np.uint8)[~flags].tobytes()
                    out.append((len(text.encode()), gone, spans, hashlib.sha256(data).hexdigest()))
                    if with_text:
                        texts.append(data.decode(errors="ignore"))
                columns = [part.column(0), *(
                    pa.array([o[k] for o in out], t) for k, t in
                    enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))]
                if with_text:
                    columns += [pa.array(texts, pa.string()), part.column(3)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    done = rows.mapInArrow(run, schema)
    return done if with_text else done.select(*names)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, same columns, with repeated bytes taken out of ``text``; an ``n_chars``
    column counts the text that is left."""
    done = dedup_bytes(docs, with_text=True, **options)
    out = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    for c in docs.columns:
        if c not in out:
            out[c] = F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("rest")[c]
    return done.select(*(out[c].alias(c) for c in docs.columns))
