"""Repeated windows of a corpus: every run of ``length`` elements (bytes or words of one document)
that also starts anywhere else.

A *cover* picks sample positions by content: of each window's runs of ``sample`` elements, the
leftmost with the least hash. Equal windows have their sample at the same distance q from their start,
wherever they stand; that is what a difference cover gives for positions, here at a density of 2 per
(length - sample). A sample owns a range of consecutive windows, so one row stands for all of them.

1. ``samples``: the rows of all documents. Ranges with one content inside a task's slice are settled
   there; one of them goes on as a witness.
2. Rows whose sample occurs once in the corpus cannot be in a repeat and end here.
3. The others get their elements and meet by sample, sorted, so a task holds one group at a time.
   ``group_repeats`` ranks the group's samples by what follows them and by what precedes them
   (sorted with longest common prefixes). A window q before a sample is q elements followed by a
   sample: within the bucket of distance q, two windows are equal when both ranks agree at depths q
   and length - q. No window is sorted element by element.
4. A sample in more than ``group_rows`` rows would make too large a group: its windows meet one by one
   by their own hash instead, counted before they are shuffled.

Every window is judged, in a group of any size, on the input as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.components import PARTS, among, join_counted
from talkgrain.llm.text import (
    byte_values, in_small_batches, mix, raw, rolling, slices, span_hash, word_hashes, word_spans,
)
from talkgrain.plans.scratch import stored

#: Rows of one group in a task, of some 300 bytes each.
GROUP_ROWS = 20_000
#: Rows that a task ranks together.
TOGETHER = 4096


@dataclass(frozen=True)
class Windows:
    """``words``: elements are words, else bytes; ``length`` of a window and of a ``sample``."""

    words: bool
    length: int
    sample: int
    group_rows: int = GROUP_ROWS

    def elements(self, data: np.ndarray, offsets: np.ndarray):
        """A value per element, the index of each row's first element, and the elements' byte spans."""
        if not self.words:
            at = np.arange(len(data) + 1)
            return byte_values(data), offsets, at[:-1], at[1:]
        start, end, first = word_spans(data, offsets)
        return word_hashes(data, start, end), first, start, end


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, all other columns as ``rest``, and (id, h), which tell rows apart unless both id
    and text are the same."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    return in_small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
        (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest")).select(
        "*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def cover(spec: Windows, value: np.ndarray, first: np.ndarray):
    """The cover's samples in a slice: window range start and number, distance from the range's start
    to the sample, the sample's hash and the hash of the whole range; and the element prefix sums."""
    none = np.zeros(0, np.int64)
    prefix = rolling(value)
    n = len(value)
    if n < spec.length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), prefix
    at = np.arange(n - spec.sample + 1)
    gram = span_hash(prefix, at, at + spec.sample)
    marked = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    least = sliding_least(marked, spec.length - spec.sample + 1)
    edge = np.zeros(n + 2, np.int64)
    size = np.diff(first)
    long = np.flatnonzero(size >= spec.length)
    edge[first[long]] += 1
    edge[first[long] + size[long] - spec.length + 1] -= 1
    window = np.flatnonzero(np.cumsum(edge)[:len(least)])
    if not len(window):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), prefix
    sample = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    turn = np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1]]))
    start, count, sample = window[turn], np.diff(np.append(turn, len(window))), sample[turn]
    whole = span_hash(prefix, start, start + count - 1 + spec.length)
    return start, count, sample - start, gram[sample], whole, prefix


def spans(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of elements that flagged windows cover."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + length - 1


def samples(rows: DataFrame, spec: Windows) -> DataFrame:
    """(id, h, key, at, n, q): sample ``key`` owns the n windows from ``at``, the first q elements
    before it. Rows without a key are repeats settled in the task: n elements from ``at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2)):
                ids, marks = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                fresh = np.zeros(b - a, bool)
                for k, key in enumerate(zip(marks.to_pylist(), np.diff(offsets).tolist(), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        fresh[k] = True
                value, first, _, _ = spec.elements(data, offsets)
                start, count, q, key, whole, _ = cover(spec, value, first)
                row = np.searchsorted(first, start, side="right") - 1
                new = fresh[row]
                start, count, q, key, whole, row = (
                    x[new] for x in (start, count, q, key, whole, row))
                content = mix(key ^ mix(whole + (q * spec.length + count).astype(np.uint64)))
                _, witness, which, times = np.unique(
                    content, return_index=True, return_inverse=True, return_counts=True)
                settled = times[which] > 1
                flags = np.zeros(len(value) + 1, np.int64)
                flags[start[settled]] += 1
                np.add.at(flags, start[settled] + count[settled], -1)
                low, high = spans(np.cumsum(flags) > 0, spec.length)
                of = np.searchsorted(first, low, side="right") - 1
                begin = np.concatenate([start[witness] - first[row[witness]], low - first[of]])
                taken = pa.array(np.concatenate([row[witness], of]))
                yield pa.RecordBatch.from_arrays([
                    ids.take(taken), marks.take(taken),
                    pa.concat_arrays([pa.array(key[witness].view(np.int64)),
                                      pa.nulls(len(low), pa.int64())]),
                    pa.array(begin), pa.array(np.concatenate([count[witness], high - low])),
                    pa.array(np.concatenate([q[witness], np.zeros(len(low), np.int64)]))],
                    ["id", "h", "key", "at", "n", "q"])

    return rows.select("id", "h", "text").mapInArrow(
        run, "id bigint, h bigint, key bigint, at bigint, n bigint, q bigint")


def contents(rows: DataFrame, spec: Windows) -> DataFrame:
    """The text under each range: rows of documents with a list ``ranges`` of (key, at, n, q)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for a, b, data, offsets in slices(batch.column(2)):
                ranges = lists.slice(a, b - a)
                per = np.diff(ranges.offsets.to_numpy())
                flat = ranges.flatten()
                key, at, n, q = (flat.field(k).to_numpy() for k in range(4))
                _, first, begin, end = spec.elements(data, offsets)
                row = np.repeat(np.arange(b - a), per)
                low = first[row] + at
                low, high = begin[low], end[low + n + spec.length - 2]
                for s in range(0, len(row), 4096):
                    part = slice(s, s + 4096)
                    size = high[part] - low[part]
                    ends = np.cumsum(size)
                    index = np.arange(ends[-1]) + np.repeat(low[part] - (ends - size), size)
                    held = pa.Array.from_buffers(pa.binary(), len(size), [
                        None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)),
                        pa.py_buffer(data[index])])
                    taken = pa.array(row[part] + a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[part]), batch.column(0).take(taken), batch.column(1).take(taken),
                         pa.array(at[part]), pa.array(n[part]), pa.array(q[part]), held],
                        ["key", "id", "h", "at", "n", "q", "content"])

    return rows.select("id", "h", "text", "ranges").mapInArrow(
        run, "key bigint, id bigint, h bigint, at bigint, n bigint, q bigint, content binary")


def ranks(group: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the rows of ``table`` (one element per column) within groups, and the common
    prefix with the row before in that order; -1 where a group begins."""
    order = np.lexsort((*table.T[::-1], group))
    sorted_table, sorted_group = table[order], group[order]
    differs = sorted_table[1:] != sorted_table[:-1]
    common = np.where(differs.any(1), differs.argmax(1), table.shape[1])
    common[sorted_group[1:] != sorted_group[:-1]] = -1
    return order, np.concatenate([[-1], common])


def byte_ranks(group: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ranks`` of rows of bytes: sorted eight at a time as big-endian numbers."""
    wide = np.zeros((len(table), -(-table.shape[1] // 8) * 8), np.uint8)
    wide[:, :table.shape[1]] = table
    order = np.lexsort((*wide.view(">u8").astype(np.uint64).T[::-1], group))
    sorted_table, sorted_group = table[order], group[order]
    differs = sorted_table[1:] != sorted_table[:-1]
    common = np.where(differs.any(1), differs.argmax(1), table.shape[1])
    common[sorted_group[1:] != sorted_group[:-1]] = -1
    return order, np.concatenate([[-1], common])


def group_repeats(spec: Windows, key: np.ndarray, n: np.ndarray, q: np.ndarray, value: np.ndarray,
                  first: np.ndarray) -> np.ndarray:
    """Flags, row by row and window by window, of the windows that equal another of their group.
    ``value`` has the elements of all rows, from ``first`` of each row on."""
    rows = len(key)
    size = first[1:] - first[:-1]
    at = first[:-1] + q

    def side(width: int, step: int) -> np.ndarray:
        place = at[:, None] + (np.arange(width) if step > 0 else -1 - np.arange(width))
        inside = (place >= first[:-1, None]) & (place < first[1:, None])
        return np.where(inside, value[np.minimum(np.maximum(place, 0), len(value) - 1)], 0)

    rank = ranks if spec.words else byte_ranks
    reach = spec.length - spec.sample + 1
    after, common_after = rank(key, side(spec.length, 1))
    before, common_before = rank(key, side(reach, -1))
    out = np.zeros(int(n.sum()), bool)
    offset = np.cumsum(n) - n
    one, two = np.empty(rows, np.int64), np.empty(rows, np.int64)
    for d in range(reach):
        bucket = np.flatnonzero((q >= d) & (q - n < d))
        if len(bucket) < 2:
            continue
        one[after] = np.cumsum(common_after < spec.length - d)
        two[before] = np.cumsum(common_before < d)
        pair = one[bucket] * (rows + 1) + two[bucket]
        _, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        again = bucket[times[which] > 1]
        out[offset[again] + q[again] - d] = True
    return out


def grouped(rows: DataFrame, spec: Windows) -> DataFrame:
    """(id, h, at, n): repeated runs of elements, from content rows that lie sorted by key."""
    names = ["id", "h", "at", "n"]

    def judge(table: pa.Table) -> pa.RecordBatch:
        column = {c: table.column(c).combine_chunks() for c in ("key", "id", "h", "at", "n", "q", "content")}
        column = {c: (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v) for c, v in column.items()}
        data, offsets = raw(column["content"])
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        value, first, _, _ = spec.elements(data, offsets)
        value = value if spec.words else data
        key, at, n, q = (column[c].to_numpy() for c in ("key", "at", "n", "q"))
        flags = group_repeats(spec, key, n, q, value, first)
        row = np.repeat(np.arange(len(n)), n)
        edge = np.flatnonzero(flags)
        if not len(edge):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names)
        cut = np.flatnonzero(np.concatenate(
            [[True], (edge[1:] != edge[:-1] + 1) | (row[edge[1:]] != row[edge[:-1]])]))
        low, high = edge[cut], edge[np.append(cut[1:], len(edge)) - 1]
        of = row[low]
        begin = at[of] + low - (np.cumsum(n) - n)[of]
        return pa.RecordBatch.from_arrays(
            [column["id"].take(pa.array(of)), column["h"].take(pa.array(of)), pa.array(begin),
             pa.array(high - low + spec.length)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for s in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(s, TOGETHER)
                key = part.column(0).to_numpy()
                # The last key of the part may go on: its rows wait for the next part.
                cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
                if cut and held:
                    yield judge(pa.Table.from_batches([*held, part.slice(0, cut)]))
                    held, count = [], 0
                elif cut:
                    yield judge(pa.Table.from_batches([part.slice(0, cut)]))
                elif held and held[-1].num_rows and held[-1].column(0)[0] != part.column(0)[0]:
                    yield judge(pa.Table.from_batches(held))
                    held, count = [], 0
                held.append(part.slice(cut))
                count += part.num_rows - cut
        if count:
            yield judge(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "id bigint, h bigint, at bigint, n bigint")


def each_window(rows: DataFrame, spec: Windows) -> DataFrame:
    """(key, q, window, id, h, at): one row per window, by its own hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                data, offsets = raw(part.column(6))
                data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
                value, first, _, _ = spec.elements(data, offsets)
                n = part.column(4).to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                low = first[row] + step
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(taken), pa.array(part.column(5).to_numpy()[row] - step),
                    pa.array(span_hash(rolling(value), low, low + spec.length).view(np.int64)),
                    part.column(1).take(taken), part.column(2).take(taken),
                    pa.array(part.column(3).to_numpy()[row] + step)],
                    ["key", "q", "window", "id", "h", "at"])

    return rows.select("key", "id", "h", "at", "n", "q", "content").mapInArrow(
        run, "key bigint, q bigint, window bigint, id bigint, h bigint, at bigint")


def repeated_runs(rows: DataFrame, spec: Windows) -> DataFrame:
    """(id, h, runs): for each ``keyed`` row with repeats its runs of repeated elements as a list of
    (at, n), unsorted and overlapping; n is -1 for a text that several rows have, which is one run
    from end to end if it holds a window at all."""
    found = stored(samples(rows, spec), "repeat-samples")
    ranges = found.where("key is not null")
    often = stored(ranges.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "repeat-often")
    live = join_counted(ranges, often, "key", "times").groupBy("id", "h").agg(
        F.collect_list(F.struct("key", "at", "n", "q")).alias("ranges"))
    live = stored(live, "repeat-ranges")
    held = contents(among(rows, "h", live, "h").join(live, ["id", "h"]), spec)
    large = stored(often.where(F.col("times") > spec.group_rows).select("key"), "repeat-large")
    runs = found.where("key is null").select("id", "h", "at", "n")
    small = held
    if not large.isEmpty():
        held = stored(held, "repeat-contents")
        small = held.join(large, "key", "left_anti")
        window = each_window(held.join(large, "key", "left_semi"), spec)
        again = window.groupBy("key", "q", "window").agg(F.count("*").alias("times")).where("times > 1")
        runs = runs.unionByName(window.join(again, ["key", "q", "window"]).select(
            "id", "h", "at", F.lit(spec.length).cast("bigint").alias("n")))
    runs = runs.unionByName(grouped(small.repartition("key").sortWithinPartitions("key"), spec))

    text = rows.select("id", "h", F.octet_length("text").alias("size"), F.xxhash64(F.lit(1), "text").alias("h2"))
    # Counted and met in parts, so that a text with very many copies is no single task's work.
    kind, part = ["h", "size", "h2"], F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part")
    text = text.select("id", *kind, part)
    counts = text.groupBy(*kind, "part").agg(F.count("*").alias("rows"))
    same = counts.join(counts.groupBy(*kind).agg(F.sum("rows").alias("all")).where("all > 1"), kind)
    whole = text.join(same, [*kind, "part"]).select(
        "id", "h", F.lit(0).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("n"))
    runs = runs.unionByName(whole)
    return runs.groupBy("id", "h").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def with_runs(rows: DataFrame, spec: Windows) -> DataFrame:
    """All ``keyed`` rows with their ``runs``, null where there are none. Only texts that have some
    are shuffled."""
    runs = stored(repeated_runs(rows, spec), "repeat-runs")
    met = among(rows, "h", runs, "h").join(runs, ["id", "h"], "left")
    return met.unionByName(
        among(rows, "h", runs, "h", "left_anti").withColumn("runs", F.lit(None).cast(
            runs.schema["runs"].dataType)), allowMissingColumns=False)


def covered(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Flags of the elements inside any of the runs."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge)[:size] > 0


def removed(spec: Windows, runs: list | None, size: int) -> np.ndarray | None:
    """Flags of the elements to remove from a document of ``size`` elements; None: nothing."""
    if not runs or size < spec.length:
        return None
    if any(r["n"] < 0 for r in runs):
        return np.ones(size, bool)
    return covered(np.array([r["at"] for r in runs]), np.array([r["n"] for r in runs]), size)
