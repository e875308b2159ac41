"""Token counts of byte-level BPE with word ends, by rank-synchronous array merging.

Inside a task, the distinct pre-tokens of some texts are held as one ragged array of symbols. Every
round finds the lowest-ranked pair of each pre-token, merges all its places in all pre-tokens at
once, and drops pre-tokens that have no pair left; the symbols that survive are the tokens. A merged
symbol has only later-ranked pairs, so taking all places of the lowest pair together gives what one
merge at a time gives.

Rows stay where they are: one pass, no shuffle. Cases: a null or empty text has 0 bytes and 0
tokens; a null id stays null; repeated rows are counted each; an empty table gives an empty table;
only ``doc_id`` and ``text`` are read. A text of any length is counted whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.text import in_small_batches, slices

LIMIT = 2048
#: Counts of so many distinct pre-tokens are remembered by a task.
REMEMBERED = 200_000
#: Text handled at once inside a task.
AT_ONCE = 1 << 20

# White space and the pre-token pattern as the tokenizer file has them.
_SPACES = "\\t\\n\\x0B\\x0C\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_PIECE = regex.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{_SPACES}\\p{{L}}\\p{{N}}]+")
_NEVER = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for the characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class WordBpe:
    """The vocabulary as arrays: symbols of bytes inside and at the end of a pre-token, and for each
    mergeable pair its rank and the symbol it becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inside = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.becomes = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.counts: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special tokens stand in it."""
        if not self.special.search(text):
            return self._plain(text), 0
        parts = self.special.split(text)
        return list(chain.from_iterable(map(self._plain, parts))), len(parts) - 1

    @staticmethod
    def _plain(text: str) -> list[str]:
        # Each character is lower-cased alone, so a capital sigma is never a final one.
        return _PIECE.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def merged_lengths(self, pieces: list[str]) -> np.ndarray:
        """The number of symbols left of each non-empty pre-token."""
        encoded = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(encoded), np.uint8)
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        symbol = self.inside[data]
        last = np.cumsum(size) - 1
        symbol[last] = self.final[data[last]]
        out = size.copy()
        live = np.arange(len(size))
        while len(live):
            first = np.cumsum(size) - size
            rank = np.full(len(symbol), _NEVER, np.int64)
            rank[:-1] = self.pair_ranks(symbol[:-1], symbol[1:])
            rank[first + size - 1] = _NEVER
            lowest = np.minimum.reduceat(rank, first)
            out[live] = size
            going = lowest < _NEVER
            if not going.all():
                keep = np.repeat(going, size)
                symbol, rank = symbol[keep], rank[keep]
                live, size, lowest = live[going], size[going], lowest[going]
                if not len(live):
                    break
                first = np.cumsum(size) - size
            hit = rank == np.repeat(lowest, size)
            at = np.flatnonzero(hit)
            # Of overlapping places (one symbol repeated), every second one from the left.
            run = np.ones(len(at), bool)
            run[1:] = at[1:] != at[:-1] + 1
            head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            symbol[at] = self.becomes[rank[at]]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            size = size - np.add.reduceat(gone.astype(np.int64), first)
            symbol = symbol[~gone]
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        split = [self.pieces(t) for t in texts]
        flat = list(chain.from_iterable(p for p, _ in split))
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        known = self.counts
        new = [p for p in dict.fromkeys(flat) if p not in known]
        if new:
            known.update(zip(new, self.merged_lengths(new).tolist(), strict=True))
        each = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(np.fromiter(map(known.__getitem__, flat), np.int64, len(flat)), out=each[1:])
        ends = np.cumsum([0, *(len(p) for p, _ in split)])
        return each[ends[1:]] - each[ends[:-1]] + np.array([s for _, s in split], np.int64)


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; ``path`` is the vocabulary file, at
    the same place on every machine."""
    rows = in_small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            text = batch.column(1)
            for a, b, _, offsets in slices(text, AT_ONCE):
                n = bpe.count([t or "" for t in text.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(n),
                     pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(
        counted, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
