"""Catalogue documents read by many tasks, against the reader of whole documents and ``json``."""

import json
import random

import pytest

from talkgrain.sources import catalogue as SC
from talkgrain.sources import documents as SD


@pytest.fixture
def splits(spark):
    """Sets how many bytes a split has."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]

    def small(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield small
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def episodes(rng, n):
    texts = ["plain", "a } b { c ] [", 'say \\"hi\\" }', "\\\\", '"episodes": [{', "\u00e9\u4e2d\U0001f600 }", "", "line\nline}}}", '\\"']
    return [{"video_id": f"v{k}", "title": rng.choice(texts), "description": rng.choice(texts) * rng.randint(0, 9),
             "tags": rng.sample(texts, 3), "view_count": k, "published_at": "2024-02-03T04:05:06",
             "metadata": {"type": "FULL", "speakers": {str(i): {"name": rng.choice(texts), "utterance_count": i}
                                                       for i in range(rng.randint(0, 3))}}} for k in range(n)]


@pytest.mark.parametrize("size", [97, 1000, 20_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_rows_of_a_split_document(spark, splits, tmp_path, size, indent):
    rng, count = random.Random(size), 8 if size < 1000 else 60
    other = {"version": {"episodes": [{"video_id": "no"}]}, "old": [{"video_id": "no", "x": {"y": "]}"}}]}
    tail = {"counts": [{"video_id": "no"}], "last": "}"}
    path = tmp_path / "one.json"
    path.write_text(json.dumps({**other, "episodes": episodes(rng, count), **tail}, indent=indent,
                               ensure_ascii=bool(indent)) + "\n" * (indent or 0), encoding="utf-8")
    want = sorted(map(str, SC.read_catalogue(spark, str(path)).collect()))
    splits(size)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 1 or size == 20_000
    assert sorted(map(str, SD.read_large_catalogue(spark, str(path)).collect())) == want
    assert len(want) == count


def test_drawn_documents(spark, splits, tmp_path):
    rng = random.Random(7)
    want = {}
    for k in range(15):
        text = json.dumps({"episodes": episodes(rng, rng.randint(0, 9))}, indent=rng.choice([None, 1]))
        cut = text[:rng.randint(1, len(text) - 1)] if k % 5 == 4 else text
        (tmp_path / f"{k}.json").write_text(cut)
        want[f"{k}.json"] = json.loads(text)["episodes"] if cut == text else []
    splits(311)
    got = {}
    for r in SD.catalogue_elements(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], {})[r.ordinal] = json.loads(r.value)
    assert got == {k: dict(enumerate(v)) for k, v in want.items() if v}


def test_cases(spark, splits, tmp_path):
    texts = {"empty": "", "none": '{"episodes": []}', "bare": "{}", "list": '[{"video_id": "x"}]', "open": '{"episodes": [',
             "cut": '{"episodes": [{"video_id": "x"}', "more": '{"episodes": [{"video_id": "x"}]}}',
             "string": '{"episodes": [{"video_id": "x}]}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    splits(10)
    assert SD.read_large_catalogue(spark, str(tmp_path)).count() == 0
    path = tmp_path / "mixed.json"
    path.write_text('{"episodes": [null, {"video_id": "a", "new": {"k": [1, {}]}}, 3, {"video_id": b}, {"video_id": "c"}]}')
    got = sorted(SD.read_documents(spark, str(path)).collect(), key=lambda r: r.ordinal)
    assert [(r.ordinal, r.video_id) for r in got] == [(0, "a"), (1, None), (2, "c")]
    assert got[1]._corrupt_record == '{"video_id": b}'
    assert [r.video_id for r in SD.read_large_catalogue(spark, str(path)).orderBy("ordinal").collect()] == ["a", "c"]
