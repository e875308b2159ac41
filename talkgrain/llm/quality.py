"""Document quality by hierarchical empirical Bayes over hosts and paths.

Each text gives evidence: the log odds of a logistic classifier on counts of its bytes and words,
less the log odds of the classes it learned from. Sites give the prior. The classifier's
probabilities of all documents are summed per host and per path; a host's posterior mean is shrunk
toward the corpus mean, a path's toward its host's, each by a strength that the spread between sites
sets (method of moments), so a site with few documents stays near the prior above it. A document's own
share is left out of its site's mean. Its posterior adds the path's log odds to its evidence.

The host is the part of ``source`` before the first "/", the path is the whole source; where a source
has no path, the language section (host/lang) stands for it, as in site.org/fr.

Sums per site are of whole millionths, so reruns agree; hot sites are summed before the shuffle.
Cases: null and empty texts have the evidence of a text without words; a null source is one site, a
null lang one section; rows with null ids are judged too, repeated rows each; without labels of both
classes all evidence is 0 and every document has the same posterior; an empty table gives an empty
table; other columns are kept by ``good_documents`` and ignored by ``posteriors``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrain.llm.components import among
from talkgrain.llm.labelled import labelled_texts
from talkgrain.llm.text import LOWER, in_small_batches, slices, word_hashes, word_spans
from talkgrain.plans.scratch import stored

#: At most so many labelled texts of each class are learned from.
PER_CLASS = 3000
#: A document is kept from this posterior probability of being good on.
KEEP_FROM = 0.5
#: Bounds of the shrinkage strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 5.0, 1000.0
#: Site posteriors stay this far from 0 and 1.
EDGE = 0.02
UNIT = 1_000_000

_KIND = np.zeros(256, np.int64)
_KIND[[*range(0x41, 0x5B)]] = 1
_KIND[[*range(0x61, 0x7B)]] = 2
_KIND[[*range(0x30, 0x3A)]] = 3
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 4
for _k, _c in enumerate(".,;:!?|#$%&*"):
    _KIND[ord(_c)] = 5 + _k
_KIND[0x80:] = 17
_KIND[[*range(0x09, 0x0E), 0x20]] = 18
_KINDS = 19


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: shares of byte kinds, word shapes, repeated words and pairs, length."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    of = np.repeat(np.arange(rows), size)
    kinds = np.bincount(of * _KINDS + _KIND[data], minlength=rows * _KINDS).reshape(rows, _KINDS)
    start, end, first = word_spans(data, offsets)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    hashed = word_hashes(LOWER[data], start, end)

    def distinct(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, at))
        values, at = values[order], at[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (at[1:] != at[:-1])
        return np.bincount(at[new], minlength=rows)

    inside = row[1:] == row[:-1]
    pair = hashed[1:] * np.uint64(0x9E3779B97F4A7C15) + hashed[:-1]
    same = np.bincount(row[1:][inside & (hashed[1:] == hashed[:-1])], minlength=rows)
    pairs = np.maximum(n - 1, 1)
    tail = _KIND[data[end - 1]] if len(end) else end
    marked = np.bincount(row[(tail >= 4) & (tail < 17)], minlength=rows)
    alone = np.bincount(row[end - start == 1], minlength=rows)
    words, total = np.maximum(n, 1), np.maximum(size, 1)
    length = np.bincount(row, weights=(end - start).astype(float), minlength=rows) / words
    upper = np.bincount(row[_KIND[data[start]] == 1], minlength=rows) if len(start) else np.zeros(rows)
    return np.column_stack([
        np.sqrt(kinds / total[:, None]), np.log1p(n), length / 10, marked / words, alone / words,
        upper / words, distinct(hashed, row) / words, same / pairs,
        distinct(pair[inside], row[1:][inside]) / pairs, n == 0,
    ])


@dataclass
class Evidence:
    """Standardised features and the weights of their log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = _expanded((x - self.mean) / self.scale) @ self.weight
        return np.clip(z, -12, 12)


def _expanded(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -6, 6)
    return np.column_stack([np.ones(len(x)), x, x * x - 1])


def train(texts: list[str], y: np.ndarray, _weight: np.ndarray) -> Evidence:
    """Learn from texts at hand."""
    column = pa.array(texts, pa.string())
    x = np.concatenate([features(np.zeros(0, np.uint8), np.zeros(1, np.int64)), *(
        features(data, offsets) for _, _, data, offsets in slices(column))])
    return learn(x, y)


def learn(x: np.ndarray, y: np.ndarray) -> Evidence:
    """Class-balanced logistic regression by Newton steps; evidence is relative to even odds."""
    if not y.sum() or y.all():
        return Evidence(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(1 + 2 * x.shape[1]))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = _expanded((x - mean) / scale)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    weight = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 1.0)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
        gradient = z.T @ (balance * (p - y)) + ridge * weight
        curve = (z * (balance * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        move = np.linalg.solve(curve, gradient)
        weight -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-9))
    return Evidence(mean, scale, weight)


def _judged(docs: DataFrame, model: Evidence) -> DataFrame:
    """``docs`` with ``evidence``, the log odds of the text alone."""
    rows = in_small_batches(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest"))
    schema = T.StructType([rows.schema["rest"], T.StructField("evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), pa.array(model.log_odds(features(data, offsets)))],
                    ["rest", "evidence"])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Evidence:
    """Learn from labelled texts, whose features are computed in tasks: only those reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2)):
                x = features(data, offsets)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["doc_id", "y", "x"])

    rows, _ = labelled_texts(in_small_batches(docs), labels, "quality", per_class)
    rows = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y int, x array<double>")
    got = rows.orderBy("doc_id").toArrow().combine_chunks()
    width = features(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[1]
    x = pa.concat_arrays(got.column("x").chunks or [pa.array([], pa.list_(pa.float64()))]).flatten()
    return learn(x.to_numpy().reshape(-1, width), got.column("y").to_numpy().astype(np.int64))


def _strength(sites: DataFrame, mean: float) -> float:
    """Documents' worth of prior that explains the spread of site means around ``mean``."""
    got = sites.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.expr("n * n")).alias("nn"),
        F.sum(F.expr(f"n * pow(s / {UNIT} / n - {mean!r}, 2)")).alias("spread")).first()
    if not got["k"] or got["k"] < 2 or not 0 < mean < 1:
        return MOST_STRENGTH
    within = mean * (1 - mean)
    between = (got["spread"] - (got["k"] - 1) * within) / max(got["n"] - got["nn"] / got["n"], 1e-9)
    return float(min(max(within / max(between, 1e-9) - 1, LEAST_STRENGTH), MOST_STRENGTH))


def posteriors(docs: DataFrame, model: Evidence) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior and quality (posterior probability of being
    good) of every row."""
    site = F.coalesce(F.col("rest.source").cast("string"), F.lit(""))
    rows = stored(_judged(docs.select("doc_id", "text", "source", "lang"), model).select(
        F.col("rest.doc_id").cast("bigint").alias("doc_id"),
        F.substring_index(site, "/", 1).alias("host"),
        F.when(F.instr(site, "/") > 0, site).otherwise(
            F.concat_ws("/", site, F.coalesce(F.col("rest.lang").cast("string"), F.lit("")))).alias("path"),
        "evidence",
        F.round(F.lit(UNIT) / (1 + F.exp(-F.col("evidence")))).cast("bigint").alias("good")),
        "quality-evidence")
    whole = rows.agg(F.count("*").alias("n"), F.sum("good").alias("s")).first()
    mean = whole["s"] / UNIT / whole["n"] if whole["n"] else 0.5
    total = [F.count("*").alias("n"), F.sum("good").alias("s")]
    hosts = stored(rows.groupBy("host").agg(*total), "quality-hosts")
    paths = stored(rows.groupBy("host", "path").agg(*total), "quality-paths")
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    told = rows.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host").join(
        paths.select("host", "path", F.col("n").alias("pn"), F.col("s").alias("ps")), ["host", "path"])
    host = F.expr(f"((hs - good) / {UNIT} + {k_host!r} * {mean!r}) / (hn - 1 + {k_host!r})")
    told = told.withColumn("host_posterior", host)
    path = F.expr(f"((ps - good) / {UNIT} + {k_path!r} * host_posterior) / (pn - 1 + {k_path!r})")
    told = told.withColumn("path_posterior", path)
    prior = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col("path_posterior")))
    return told.select(
        "doc_id", "host", "path", "evidence", "host_posterior", "path_posterior",
        (1 / (1 + F.exp(-(F.col("evidence") + F.log(prior / (1 - prior)))))).alias("quality"))


def judged(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """``posteriors`` with ``keep``: whether the document is good enough."""
    return posteriors(docs, fit(docs, labels)).withColumn("keep", F.col("quality") >= keep_from)


def good_documents(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, same columns, whose id is not among those judged too poor. Rows without
    an id stay; of rows with one id none stays if one is too poor."""
    poor = stored(judged(docs, labels, keep_from).where("not keep").select("doc_id").distinct(),
                  "quality-poor")
    return among(docs, "doc_id", poor, "doc_id", "left_anti")
