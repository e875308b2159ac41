import random

from pyspark.sql import functions as F

from talkgrain.operators import samples as S

DDL = "video_id string, pos bigint, speaker int, transcript string"


def expected_sample(utterances, max_chars=4000, size=20):
    n = len(utterances)
    out, total = [], 0
    for first, count in ((0, min(size, n)), (n // 2, min(size, n // 2)),
                         (max(0, n - size), min(size, n))):
        if total >= max_chars:
            break
        out.append(S.BEGINNING if first == 0 else S.MIDDLE if first == n // 2 else S.END)
        used = 0
        for speaker, text in utterances[first:first + count]:
            if speaker is None or text is None:
                continue
            line = f"Speaker {speaker}: {text}"
            out.append(line)
            used += len(line)
            total += len(line)
            if used > max_chars / 3:
                break
    return "\n".join(out)


def test_transcript_sample(spark):
    rng = random.Random(11)
    data, rows = {}, []
    for n in (0, 1, 2, 19, 20, 21, 38, 39, 40, 41, 42, 60, 100):
        for chars in (20, 100, 500, 3000):
            video = f"{n}-{chars}"
            data[video] = [
                (None if rng.random() < 0.05 else rng.randint(0, 3),
                 "x" * rng.randint(chars // 2, chars)) for _ in range(n)
            ]
            rows += [(video, i, s, t) for i, (s, t) in enumerate(data[video])]
    known = spark.createDataFrame([(v,) for v in data], "video_id string")
    got = S.transcript_sample(spark.createDataFrame(rows, DDL), known)
    assert {r.video_id: r.sample for r in got.collect()} == {
        v: expected_sample(u) for v, u in data.items()}


def test_plain_sample(scalar):
    lines = [str(i) for i in range(31)]
    want = [S.BEGINNING, *lines[:10], S.MIDDLE, *lines[10:20], S.END, *lines[-10:]]
    assert scalar(S.plain_sample("x"), ["\n".join(lines), "\n".join(lines[:30])]) == [
        "\n".join(want), "\n".join(lines[:30])]


def test_conversation_turns(spark):
    samples = spark.createDataFrame(
        [
            ("a", "--- HEAD ---\nSpeaker 0: hi: there\n more \nSpeaker 1\ncont\nSpeaker 0:"),
            ("b", "no speaker at all"),
            ("c", "Speaker 2: one\n\nSpeaker 2: two"),
        ],
        "video_id string, sample string",
    )
    turns = S.conversation_turns(samples).orderBy("video_id", "turn").collect()
    assert [(r.video_id, r.speaker, r.text) for r in turns] == [
        ("a", "Speaker 0", "hi: there more"), ("a", "Speaker 1", " cont"),
        ("c", "Speaker 2", "one "), ("c", "Speaker 2", "two")]
    text = S.conversation_text(S.conversation_turns(samples)).where("video_id = 'c'").first()
    assert text.conversation == "Speaker 2: one \nSpeaker 2: two"


def test_prompt_has_every_ingredient(spark):
    episodes = spark.createDataFrame(
        [("a", "A title", "A talk with Ann Lee.")],
        "video_id string, title string, description string")
    talk = spark.createDataFrame([("a", "Speaker 0: hi")], "video_id string, conversation string")
    prompt = S.speaker_prompts(episodes, talk, [("Bo", "calm"), ("Cy", "")]).first().prompt
    for part in ("A title", "A talk with Ann Lee.", "ann lee", "Speaker 0: hi", "1. Bo",
                 "2. Cy", "- Bo: calm", '"hosts"', '"guests"'):
        assert part in prompt
    assert "- Cy" not in prompt
    silent = S.speaker_prompts(episodes, talk.limit(0), [("Bo", "")]).collect()
    assert len(silent) == 1 and silent[0].prompt.startswith("Name the speakers")


def test_head_sample(spark):
    rows = spark.createDataFrame(
        [(["v"], [(i if i else None, f"t{i}") for i in range(12)])],
        "id array<string>, u array<struct<speaker: int, transcript: string>>")
    documents = rows.select(
        F.struct(F.col("u").alias("utterances")).alias("results"),
        F.struct(F.col("id")[0].alias("video_id")).alias("episode_metadata"))
    sample = S.head_sample(documents).first().sample.split("\n")
    assert sample == ["Speaker ?: t0"] + [f"Speaker {i}: t{i}" for i in range(1, 10)]


def test_samples_in_documents_equal_the_row_form(spark):
    import random

    rng = random.Random(6)
    rows = []
    for n in (0, 1, 2, 19, 20, 21, 38, 39, 40, 41, 60, 100):
        for i in range(n):
            speaker, text = rng.choice([0, 1, 2, None]), "x" * rng.choice([20, 100, 500, 3000])
            rows.append((f"v{n}", i, speaker, None if rng.random() < 0.1 else text))
    flat = spark.createDataFrame(rows, "video_id string, pos bigint, speaker int, transcript string")
    ids = spark.createDataFrame([(f"v{n}",) for n in (0, 1, 2, 19, 20, 21, 38, 39, 40, 41, 60, 100)], "video_id string")
    lists = flat.groupBy("video_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "speaker", "transcript"))),
        lambda x: F.struct(x["speaker"].alias("speaker"), x["transcript"].alias("transcript"))).alias("u"))
    documents = ids.join(lists, "video_id", "left").select(
        F.struct(F.coalesce("u", F.expr("cast(array() as array<struct<speaker: int, transcript: string>>)"))
                 .alias("utterances"), F.lit("p").alias("transcript")).alias("results"),
        F.struct("video_id").alias("episode_metadata"))
    want = sorted(map(tuple, S.transcript_sample(flat, ids).collect()))
    assert sorted(map(tuple, S.sample_in_document(documents).collect())) == want


def test_plain_text_is_sampled_only_without_utterances(spark):
    rows = spark.sql("""
        select named_struct('utterances', cast(null as array<struct<speaker: int, transcript: string>>),
                            'transcript', 'plain text') results, named_struct('video_id', 'v') episode_metadata""")
    assert S.sample_in_document(rows).first().sample == "plain text"
