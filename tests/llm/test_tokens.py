"""Token counts against the tokenizers library."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from talkgrain.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def strange(n):
    rng = random.Random(2)
    alphabet = [chr(c) for c in (
        *range(0, 0x250), 0x3A3, 0x3C3, 0x130, 0x1C5, *range(0x300, 0x310), *range(0x2000, 0x2070), 0x3000,
        0xFEFF, 0x1F600, 0x4E00, 0xAC00, 0x1100, 0x1161, 0x11A8, 0xFB01, 0x2126, 0x660, 0xBD, 0x2167, 0x10400)]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts_of_strange_texts():
    texts = [*strange(3000), "aaaaaaa", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|END", "  ",
             "ΑΣ ΑΣΑ", "it's we'll I'D", "a" * 5000, "thethe" * 2000, "éa" * 700]
    assert tokens.load(PATH).count(texts).tolist() == library(texts)


def test_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: (len(r["text"].encode()), n, n > 2048)
            for r, n in zip(rows, library([r["text"] for r in rows]), strict=True)}
    got = tokens.count_tokens(docs, PATH).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows)


def test_cases(documents):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 2048), (3, "x " * 2049)]
    got = sorted(map(tuple, tokens.count_tokens(documents(rows), PATH).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False), (3, 4096, 2048, False),
                          (3, 4098, 2049, True)], key=str)
    assert tokens.count_tokens(documents([]), PATH).count() == 0
