import random

from talkgrain import schemas
from talkgrain.operators import speakers as P
from talkgrain.sources.catalogue import typed_episodes

UTTERANCES = "video_id string, pos bigint, speaker int, transcript string"


def said(video, speakers):
    return [(video, i, s, f"t{i}") for i, s in enumerate(speakers)]


def test_stats_and_samples(spark):
    rows = spark.createDataFrame(
        said("v", [1, 0, 1, None, 1]) + said("long", [5] * 25), UTTERANCES)
    stats = {(r.video_id, r.speaker): (r.utterance_count, r.first_pos, r.speaker_tag)
             for r in P.speaker_stats(rows).collect()}
    assert stats == {("v", 1): (3, 0, "Speaker 1"), ("v", 0): (1, 1, "Speaker 0"),
                     ("long", 5): (25, 0, "Speaker 5")}
    samples = {(r.video_id, r.speaker): r.samples for r in P.speaker_samples(rows).collect()}
    assert samples[("long", 5)] == [f"t{i}" for i in range(10)]
    assert samples[("v", 1)] == ["t0", "t2", "t4"]
    assert {r.video_id: r.speaker_count for r in P.speaker_count(rows).collect()} == {
        "v": 2, "long": 1}


def parsed(spark, *texts):
    rows = spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(texts)], "video_id string, response string")
    return P.parse_responses(rows).orderBy("video_id")


def test_parse_responses(spark):
    got = parsed(
        spark,
        '{"hosts": [{"name": "A", "confidence": 0.9}], "guests": []}',
        'Sure:\n{"guests": [{"name": "G"}]}\nbye',
        '{"hosts": []} and {"guests": [{"name": "X"}]}',
        "no idea",
        None,
        "{}",
    ).collect()
    names = [([p.name for p in r.hosts], [p.name for p in r.guests]) for r in got]
    assert names[0] == (["A"], [])
    assert names[1] == ([], ["G"])
    assert names[3:] == [([], []), ([], []), ([], [])]


def test_candidates_collapse_repeats(spark):
    got = P.candidate_names(parsed(
        spark,
        '{"hosts": [{"name": "A", "confidence": 0.5}, {"name": "B"}, {"name": ""},'
        ' {"name": "A", "confidence": 0.6}], "guests": [{"name": "G"}, {"confidence": 1}]}',
    ))
    assert sorted((r.kind, r.name_rank, r.name, r.confidence) for r in got.collect()) == [
        ("guest", 1, "G", 0.7), ("host", 1, "A", 0.6), ("host", 2, "B", 0.8)]


def expected_names(order, counts, hosts, guests):
    """order: speakers by first appearance; hosts / guests: name -> confidence."""
    named = {}
    ranked = sorted(order, key=lambda s: -counts[s])
    for speaker, (name, confidence) in zip(ranked, hosts.items(), strict=False):
        named[speaker] = (name, confidence, False, False)
    free = [s for s in order if s not in named]
    for speaker, (name, confidence) in zip(free, guests.items(), strict=False):
        named[speaker] = (name, confidence, True, False)
    for s in order:
        named.setdefault(s, (f"Unknown Speaker {s}", 0.1, False, True))
    return named


def test_assignment_of_random_episodes(spark):
    rng = random.Random(3)
    rows, candidates, want = [], [], {}
    for v in range(60):
        speakers = [rng.randint(0, rng.randint(0, 6)) for _ in range(rng.randint(1, 40))]
        rows += said(str(v), speakers)
        order = list(dict.fromkeys(speakers))
        hosts = {f"H{i}": round(rng.random(), 2) for i in range(rng.randint(0, 4))}
        guests = {f"G{i}": round(rng.random(), 2) for i in range(rng.randint(0, 4))}
        for kind, people in (("host", hosts), ("guest", guests)):
            candidates += [(str(v), kind, n, c, i + 1) for i, (n, c) in enumerate(people.items())]
        counts = {s: speakers.count(s) for s in order}
        for s, r in expected_names(order, counts, hosts, guests).items():
            want[(str(v), s)] = r
    got = P.assign_names(
        P.speaker_stats(spark.createDataFrame(rows, UTTERANCES)),
        spark.createDataFrame(
            candidates,
            "video_id string, kind string, name string, confidence double, name_rank int"),
    )
    assert {(r.video_id, r.speaker): (r.name, r.confidence, r.is_guest, r.is_unknown)
            for r in got.collect()} == want


def test_maps_new_entries_win(spark):
    entry = {"utterance_count": 1, "confidence": 0.1, "is_guest": False, "is_unknown": True,
             "identified_by_llm": False}
    row = {"video_id": "v", "speaker_count": 9, "metadata": {"speakers": {
        "0": entry | {"name": "old 0"}, "7": entry | {"name": "old 7"}}}}
    bare = {"video_id": "bare"}
    stored = typed_episodes(spark.createDataFrame(
        [row, bare], schemas.struct_type(schemas.EPISODE_FILE_DDL)))
    stats = P.speaker_stats(spark.createDataFrame(said("v", [0, 1]), UTTERANCES))
    nobody = P.candidate_names(parsed(spark, "none"))
    merged = P.merge_speakers(stored, P.speakers_map(P.assign_names(stats, nobody)))
    by_id = {r.video_id: r for r in merged.collect()}
    found = {k: v.name for k, v in by_id["v"].metadata.speakers.items()}
    assert found == {"0": "Unknown Speaker 0", "1": "Unknown Speaker 1", "7": "old 7"}
    assert by_id["v"].speaker_count == 2
    assert by_id["bare"].metadata.speakers is None and by_id["bare"].speaker_count is None
