"""Toxicity scores by a convolutional text classifier trained in numpy.

Words (runs of letters and digits, lower-cased) have hashed embeddings: the sum of a row for the
word and of rows for its first bytes, so inflected and compound forms share what they begin with.
Filters of several widths slide over them, each keeps its largest response in the text, and a linear
layer gives the logit. The network learns from every labelled text outside the held-out fifth, whole, but for a
fifth of them by which the thresholds, one per language as told from the text's own function words, are set;
these are moved to a score of 0.5.

Scoring reads each text once, whole, in one pass without a shuffle. Scores depend on the text alone.
Cases: a null or empty text has the score of a text without words; null ids are not held out; repeated
rows are scored each; without labels of both classes every score is the share of toxic labels (0 if
there are none); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.labelled import fold, once_each, parted_texts
from talkgrain.llm.text import byte_values, in_small_batches, mix, rolling, slices, span_hash

#: Labelled rows of a part, and the most parts; more rows make larger parts.
PER_PART = 6000
PARTS = 32
#: Times that every part is gone through, where there are several.
PASSES = 2
#: Steps at least on the rows that a task holds at once.
LEAST_STEPS = 100
#: Bytes of the first rows, of rows held by a task, and of texts whose gradients are taken at once.
FIRST_BYTES = 1 << 26
CHUNK_BYTES = 1 << 24
STEP_BYTES = 1 << 20
BUCKETS = 1 << 15
DIMENSIONS = 16
FILTERS = 16
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
STEPS = 1000
BATCH = 48
#: A language gets a threshold of its own from so many toxic rows on.
LANGUAGE_ROWS = 12

# Frequent function words by which a text's language is told.
FUNCTION_WORDS = (
    ("the", "and", "of", "to", "is", "that", "with", "for"),
    ("der", "die", "und", "das", "den", "ist", "nicht", "von"),
    ("le", "la", "les", "des", "et", "est", "dans", "pour"),
    ("el", "los", "las", "y", "del", "por", "con", "una"),
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 lower-cased."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray):
    """Hash of every word, hashes of its prefixes (0 where it is shorter), first word of each row."""
    if not len(data):
        none = np.zeros(0, np.uint64)
        return none, np.zeros((0, len(PREFIXES)), np.uint64), np.zeros(len(offsets), np.int64)
    data = letters(data)
    word = _LETTER[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner], ends[inner - 1] = word[inner], word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    prefix = rolling(byte_values(data))
    parts = np.zeros((len(start), len(PREFIXES)), np.uint64)
    for k, n in enumerate(PREFIXES):
        long = end - start > n
        parts[long, k] = mix(span_hash(prefix, start[long], start[long] + n) + np.uint64(n))
    return span_hash(prefix, start, end), parts, np.searchsorted(start, offsets)


def _known() -> tuple[np.ndarray, np.ndarray]:
    pairs = []
    for k, group in enumerate(FUNCTION_WORDS):
        for w in group:
            data = np.frombuffer(w.encode(), np.uint8)
            pairs.append((int(words(data, np.array([0, len(data)]))[0][0]), k + 1))
    pairs.sort()
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])


_KNOWN, _LANGUAGE = _known()


@dataclass
class Batch:
    """Distinct words of some texts: bucket rows of each (0: none), its language mark, and the texts
    as positions in that list; two empty words follow each text, and two more the last."""

    rows: np.ndarray
    at: np.ndarray
    first: np.ndarray
    language: np.ndarray


def prepared(data: np.ndarray, offsets: np.ndarray) -> Batch:
    hashed, parts, first = words(data, offsets)
    kinds, pick, which = np.unique(hashed, return_index=True, return_inverse=True)
    features = np.concatenate([kinds[:, None], parts[pick]], 1)
    rows = (mix(features) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    rows[features == 0] = 0
    rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.int64)])
    n = np.diff(first)
    docs = len(n)
    start = first[:-1] + 2 * np.arange(docs)
    at = np.full(len(hashed) + 2 * docs + 2, len(kinds), np.int64)
    at[np.arange(len(hashed)) + 2 * np.repeat(np.arange(docs), n)] = which
    place = np.minimum(np.searchsorted(_KNOWN, kinds), len(_KNOWN) - 1)
    mark = np.where(_KNOWN[place] == kinds, _LANGUAGE[place], 0)
    found = np.bincount(np.repeat(np.arange(docs), n) * 5 + mark[which], minlength=5 * docs).reshape(docs, 5)
    found[:, 0] = 0
    return Batch(rows, at, start, np.where(found.max(1) > 0, found.argmax(1), 0))


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    constant: float
    thresholds: np.ndarray

    def pooled(self, batch: Batch) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Largest response of every filter in every text; the responses; the word vectors."""
        vectors = self.embedding[batch.rows].sum(1)
        out, responses = [], []
        for k, filters in enumerate(self.filters):
            width = len(filters)
            total = None
            for j in range(width):
                part = (vectors @ filters[j])[batch.at[j:len(batch.at) - 2 + j]]
                total = part if total is None else total + part
            # What begins at an empty word would reach into the next text.
            total[batch.at[:len(total)] == len(batch.rows) - 1] = 0
            responses.append(total)
            out.append(np.maximum.reduceat(total, batch.first, axis=0) + self.bias[k])
        return np.concatenate(out, 1), responses, vectors

    def logits(self, batch: Batch) -> np.ndarray:
        return np.maximum(self.pooled(batch)[0], 0) @ self.weight + self.constant

    def scores(self, batch: Batch) -> np.ndarray:
        if not len(batch.first):
            return np.zeros(0)
        z = self.logits(batch) - self.thresholds[batch.language]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _texts(texts: list[str]) -> Batch:
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    return prepared(np.frombuffer("".join(texts).encode(), np.uint8), offsets)


def _unlearned(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    model = Model(
        rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros((len(WIDTHS), FILTERS), np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0,
        np.zeros(5))
    model.embedding[0] = 0
    return model


class _Adam:
    """Adam on the log loss of a model's batches; ``moved`` counts the steps that moved each word vector."""

    def __init__(self, model: Model, rng: np.random.Generator):
        self.model, self.rng, self.t = model, rng, 0
        self.moments: dict[str, list[np.ndarray]] = {}
        self.moved = np.zeros(BUCKETS, np.int64)

    def _step(self, name: str, value: np.ndarray, grad: np.ndarray, rate: float, rows=None) -> None:
        m, v = self.moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        if rows is None:
            rows = slice(None)
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.999 * v[rows] + 0.001 * grad * grad
        value[rows] -= rate * (m[rows] / (1 - 0.9 ** self.t)) / (np.sqrt(v[rows] / (1 - 0.999 ** self.t)) + 1e-8)

    def learn(self, texts: list[str], target: np.ndarray, rate: float) -> None:
        """One step on a batch. Long texts are gone through a few at a time, and their gradients summed."""
        model = self.model
        self.t += 1
        drop = (self.rng.random((len(texts), len(WIDTHS) * FILTERS)) > 0.2).astype(np.float32) / 0.8
        total, kinds, grads = None, [], []
        for a, b in _spans(texts, STEP_BYTES):
            part, rows, moved = self._gradients(_texts(texts[a:b]), target[a:b], drop[a:b], len(texts))
            total = part if total is None else [x + y for x, y in zip(total, part, strict=True)]
            kinds.append(rows)
            grads.append(moved)
        *d_filters, d_bias, d_weight, d_constant = total
        for k, d in enumerate(d_filters):
            self._step(f"filter{k}", model.filters[k], d, rate)
        self._step("bias", model.bias, d_bias, rate)
        rows, moved = kinds[0], grads[0]
        if len(kinds) > 1:
            rows, which = np.unique(np.concatenate(kinds), return_inverse=True)
            moved = np.zeros((len(rows), DIMENSIONS), np.float32)
            np.add.at(moved, which, np.concatenate(grads))
        self._step("embedding", model.embedding, moved, rate, rows)
        self.moved[rows] += 1
        self._step("weight", model.weight, (d_weight + 1e-4 * model.weight).astype(np.float32), rate)
        model.constant -= rate * d_constant

    def _gradients(self, batch: Batch, target: np.ndarray, drop: np.ndarray, n: int):
        """Of the filters, biases, weights and the constant; rows of the embedding, and theirs."""
        model = self.model
        pooled, responses, vectors = model.pooled(batch)
        active = np.maximum(pooled, 0)
        z = np.clip((active * drop) @ model.weight + model.constant, -30, 30)
        error = (1 / (1 + np.exp(-z)) - target) / n
        d_pooled = error[:, None] * model.weight * drop * (pooled > 0)
        ends = np.append(batch.first[1:], len(responses[0]))
        d_vectors = np.zeros_like(vectors)
        d_filters = []
        for k, filters in enumerate(model.filters):
            d = d_pooled[:, k * FILTERS:(k + 1) * FILTERS]
            best = np.stack([responses[k][a:b].argmax(0) + a
                             for a, b in zip(batch.first, ends, strict=True)])
            d_filter = np.zeros_like(filters)
            moved = np.where(batch.at[best] == len(batch.rows) - 1, 0, d)
            for j in range(len(filters)):
                word = batch.at[best + j]
                d_filter[j] = np.einsum("df,dfe->ef", moved, vectors[word])
                np.add.at(d_vectors, word.ravel(), (moved[:, :, None] * filters[j].T).reshape(-1, DIMENSIONS))
            d_filters.append(d_filter)
        used = np.flatnonzero(np.abs(d_vectors).max(1) > 0)
        bucket = batch.rows[used]
        d_rows = np.repeat(d_vectors[used], bucket.shape[1], axis=0)
        kinds, which = np.unique(bucket.ravel(), return_inverse=True)
        d_embedding = np.zeros((len(kinds), DIMENSIONS), np.float32)
        np.add.at(d_embedding, which, d_rows)
        real = kinds > 0
        return [*d_filters, d_pooled.sum(0).reshape(len(WIDTHS), FILTERS), (active * drop).T @ error,
                float(error.sum())], kinds[real], d_embedding[real]


def _spans(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many bytes, or of one text."""
    a = size = 0
    for b, text in enumerate(texts):
        more = 4 * len(text) if len(text) > most // 4 else len(text.encode())
        if b > a and size + more > most:
            yield a, b
            a, size = b, 0
        size += more
    yield a, len(texts)


def _balanced(rng: np.random.Generator, y: np.ndarray, least: int, times: int = 1) -> Iterator[np.ndarray]:
    """Rows of each step, half of them of each class, in at least so many steps: every row comes so many times, and
    none once more before all of its class have come."""
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    classes = [c for c in classes if len(c)]
    half = BATCH // 2
    steps = max([least, *(times * -(-len(c) // half) for c in classes)]) if classes else 0
    drawn = [np.concatenate([rng.permutation(c) for _ in range(-(-steps * half // len(c)))]) for c in classes]
    for t in range(steps):
        yield np.concatenate([d[t * half:(t + 1) * half] for d in drawn])


def train(texts: list[str], y: np.ndarray, stands_for: np.ndarray, seed: int = 7) -> Model:
    """Learns from class-balanced batches, from every row at least twice; a fifth of the rows sets the thresholds."""
    model = _unlearned(seed)
    share = float((y * stands_for).sum() / stands_for.sum()) if len(y) else 0.0
    aside = np.arange(len(y)) % 5 == 0
    learn = np.flatnonzero(~aside)
    if len(np.unique(y[learn])) < 2:
        return _constant(model, share)
    rng = np.random.default_rng(seed + 1)
    adam = _Adam(model, rng)
    drawn = list(_balanced(rng, y[learn], STEPS, 2))
    for t, rows in enumerate(drawn):
        rows = learn[rows]
        adam.learn([texts[r] for r in rows], y[rows].astype(np.float32), 0.01 * (1 - t / len(drawn)) + 0.0005)
    held = np.flatnonzero(aside)
    z, language = _judged(model, [texts[r] for r in held])
    _set_thresholds(model, z, language, y[held], stands_for[held])
    return model


def _constant(model: Model, share: float) -> Model:
    model.weight[:] = 0
    model.constant = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    return model


def _judged(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Logit and language of each text."""
    z, language = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for a, b in _spans(texts, STEP_BYTES) if texts else ():
        batch = _texts(texts[a:b])
        z[a:b], language[a:b] = model.logits(batch), batch.language
    return z, language


def _set_thresholds(model: Model, z: np.ndarray, language: np.ndarray, y: np.ndarray, stands_for: np.ndarray) -> None:
    everywhere = best_threshold(z, y, stands_for, 0.0)
    model.thresholds[:] = everywhere
    for k in range(5):
        own = language == k
        if y[own].sum() >= LANGUAGE_ROWS and (1 - y[own]).sum() >= LANGUAGE_ROWS:
            model.thresholds[k] = best_threshold(z[own], y[own], stands_for[own], everywhere)


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray, otherwise: float) -> float:
    """The middle of the logits between which the weighted F1 of "at least this" is largest."""
    if not y.sum() or y.all():
        return otherwise
    order = np.argsort(-z)
    z, y, weight = z[order], y[order], weight[order]
    true = np.cumsum(weight * y)
    f1 = 2 * true / (np.cumsum(weight) + (weight * y).sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    at = best[len(best) // 2]
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at] - 0.5)


def fit(docs: DataFrame, labels: DataFrame, per_part: int = PER_PART) -> Model:
    """Learns from all labelled rows that are not held out.

    The first rows give a model on the driver. Where there are more, each part of the rows then learns on from that model
    in a task of its own, row by row, and the mean of what the parts have learned is where the next pass begins; a word
    vector is the mean over the parts that moved it. The rows kept aside in all parts set the thresholds.
    """
    rows, totals = parted_texts(docs, labels, "toxic", per_part, PARTS)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        first = min(per_part, max(BATCH, FIRST_BYTES * size[0] // max(1, size[1] or 0)))
        order = F.xxhash64("doc_id"), "doc_id", "text"
        head = rows.where("part = 0").orderBy(*order).limit(first).toArrow()
        known = list(once_each(head.to_batches()))
        texts, y = [t for t, _ in known], np.array([c for _, c in known], np.int64)
        if size[0] <= head.num_rows:
            seen = np.bincount(y, minlength=2)
            weight = np.array([totals.get(k, 0) / max(1, seen[k]) for k in (0, 1)])
            return train(texts, y, weight[y] if len(y) else np.zeros(0))
        model = train(texts, y, np.ones(len(y)))
        if not model.weight.any():
            model = _unlearned(7)
        for turn in range(PASSES):
            model = _passed(rows, model, turn)
        return _settled(rows, model, totals)
    finally:
        rows.unpersist()


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The rows of a part that are learned from, some at a time; every fifth is kept aside."""
    texts, y, size = [], [], 0
    for i, (text, c) in enumerate(once_each(batches)):
        if i % 5 == 0:
            continue
        texts.append(text)
        y.append(c)
        size += len(text)
        if len(texts) >= PER_PART or size >= CHUNK_BYTES:
            yield texts, np.array(y, np.int64)
            texts, y, size = [], [], 0
    if texts:
        yield texts, np.array(y, np.int64)


def _passed(rows: DataFrame, model: Model, turn: int) -> Model:
    """What the parts have learned from all of their rows, from ``model`` on."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rate = 0.003 * (1 - turn / PASSES) + 0.0005

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The broadcast value serves other tasks of this process too.
        own, adam, n, before = copy.deepcopy(shared.value), None, 0, None
        for texts, y in _chunks(batches):
            n += len(texts)
            adam = adam or _Adam(own, np.random.default_rng([7, turn, len(texts)]))
            if before and len(np.unique(y)) == 1 != len(np.unique(before[1])):
                # A chunk of one class meets the other class of the last chunk that had both.
                other = np.flatnonzero(before[1] != y[0])
                texts, y = texts + [before[0][k] for k in other], np.concatenate([y, before[1][other]])
            elif len(np.unique(y)) == 2:
                before = texts, y
            for at in _balanced(adam.rng, y, LEAST_STEPS):
                adam.learn([texts[k] for k in at], y[at].astype(np.float32), rate)
        if adam:
            at = np.flatnonzero(adam.moved)
            yield pa.RecordBatch.from_pylist([{
                "n": n, "at": at.astype(np.int64).tobytes(), "moved": adam.moved[at].tobytes(),
                "vectors": own.embedding[at].tobytes(), "rest": _packed(own).tobytes()}], _LEARNED)

    total = np.zeros((BUCKETS, DIMENSIONS))
    moved, rest, n = np.zeros(BUCKETS), 0.0, 0
    learned = rows.select("doc_id", "text", "y").mapInArrow(
        run, "n bigint, at binary, moved binary, vectors binary, rest binary")
    for r in learned.collect():
        at, times = np.frombuffer(r["at"], np.int64), np.frombuffer(r["moved"], np.int64)
        total[at] += times[:, None] * np.frombuffer(r["vectors"], np.float32).reshape(-1, DIMENSIONS)
        moved[at] += times
        rest, n = rest + r["n"] * np.frombuffer(r["rest"], np.float64), n + r["n"]
    shared.destroy()
    if not n:
        return model
    touched = moved > 0
    model.embedding[touched] = (total[touched] / moved[touched, None]).astype(np.float32)
    return _unpacked(model, rest / n)


_LEARNED = pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("at", "moved", "vectors", "rest"))])


def _packed(model: Model) -> np.ndarray:
    """All of the model but word vectors and thresholds."""
    return np.concatenate([*(f.ravel() for f in model.filters), model.bias.ravel(), model.weight, [model.constant]]).astype(
        np.float64)


def _unpacked(model: Model, packed: np.ndarray) -> Model:
    shapes = [*(f.shape for f in model.filters), model.bias.shape, model.weight.shape]
    ends = np.cumsum([np.prod(s) for s in shapes])
    *filters, bias, weight = (x.reshape(s).astype(np.float32)
                              for x, s in zip(np.split(packed[:-1], ends[:-1]), shapes, strict=True))
    return Model(model.embedding, filters, bias, weight, float(packed[-1]), model.thresholds)


def _settled(rows: DataFrame, model: Model, totals: dict[int, int]) -> Model:
    """The model with the thresholds of the rows kept aside, or, where no class but one was learned from, that share."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, learned, texts, y, size = [0, 0], [0, 0], [], [], 0

        def told():
            z, language = _judged(shared.value, texts)
            return pa.RecordBatch.from_arrays(
                [pa.array(y, pa.int32()), pa.array(z), pa.array(language, pa.int32()), *(
                    pa.array([n] + [0] * (len(y) - 1), pa.int64()) for n in (*seen, *learned))], _JUDGED)

        for i, (text, c) in enumerate(once_each(batches)):
            seen[c] += 1
            if i % 5:
                learned[c] += 1
                continue
            if len(texts) >= 1000 or size >= CHUNK_BYTES:
                seen[c] -= 1
                yield told()
                seen, learned, texts, y, size = [0, 0], [0, 0], [], [], 0
                seen[c] += 1
            texts.append(text)
            y.append(c)
            size += len(text)
        if texts:
            yield told()

    got = rows.select("doc_id", "text", "y").mapInArrow(
        run, "y int, z double, language int, seen0 bigint, seen1 bigint, learned0 bigint, learned1 bigint").toArrow()
    shared.destroy()
    y, z, language, *counts = (got.column(k).to_numpy() for k in range(7))
    seen, learned = ([int(c.sum()) for c in counts[k:k + 2]] for k in (0, 2))
    if not all(learned):
        return _constant(model, totals.get(1, 0) / max(1, sum(totals.values())))
    weight = np.array([totals.get(k, 0) / max(1, seen[k]) for k in (0, 1)])
    _set_thresholds(model, z, language, y.astype(np.int64), weight[y])
    return model


_JUDGED = ["y", "z", "language", "seen0", "seen1", "learned0", "learned1"]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array(shared.value.scores(prepared(data, offsets)).astype(np.float64))],
                    ["doc_id", "score"])

    rows = in_small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
