"""Exact word-level deduplication over samples drawn by content.

A word goes if any ``length`` consecutive words around it also start anywhere else. The windows of a text
are anchored at their cover samples, the least-hashed ``sample`` words of each. Samples that occur once end
there; the rows of the others meet by sample, are sorted by what precedes and follows it, and windows with
equal ranks on both sides are repeats. A sample with more rows than a task should hold is split by whole
windows (``talkgrain.llm.repeats``, shared with the byte-level operator). No suffix tree is built: this
departs from the method of prefix-partitioned trees, as the README says.

Cases: a null text has no words; fewer than ``length`` words lose nothing; a text that several rows
have loses all its words in each; null ids and repeated rows are rows of their own; an empty table
gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talkgrain.llm.repeats import Windows, keyed, removed, with_runs
from talkgrain.llm.text import slices, word_spans

LENGTH = 35
SAMPLE = 10


def dedup_words(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE,
                group_rows: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space)."""
    spec = Windows(True, length, sample, **({"group_rows": group_rows} if group_rows else {}))
    rows = with_runs(keyed(docs.select("doc_id", "text")), spec).select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                start, end, first = word_spans(data, offsets)
                held, out = data.tobytes(), []
                for k, runs in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    low, high = start[first[k]:first[k + 1]], end[first[k]:first[k + 1]]
                    flags = removed(spec, runs, len(low))
                    gone = 0
                    if flags is not None:
                        gone = int(flags.sum())
                        low, high = low[~flags], high[~flags]
                    kept = b" ".join(held[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True))
                    out.append((gone, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.diff(first)),
                    pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
