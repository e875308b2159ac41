from pyspark.sql import functions as F

from talkgrain.functions import episodes as E
from talkgrain.functions import transcripts as X


def test_duration_seconds(scalar):
    texts = ["PT1H30M45S", "PT2M59S", "PT3M", "P1DT2H", "P1M", "P0D", "", None, "PT100H"]
    assert scalar(E.duration_seconds("x"), texts) == [5445, 179, 180, 7200, 60, 0, 0, 0, 360000]


def test_episode_type_is_inclusive(scalar):
    assert scalar(E.episode_type("x"), [179, 180, 181], "x int") == ["SHORT", "FULL", "FULL"]
    assert scalar(E.episode_type("x", 120), [119, 120], "x int") == ["SHORT", "FULL"]


def test_clock(scalar):
    shown = scalar(E.clock("x"), [0, 59, 3600, 5445, 86400, 180061], "x bigint")
    assert shown == ["0:00:00", "0:00:59", "1:00:00", "1:30:45", "1 day, 0:00:00",
                     "2 days, 2:01:01"]


def test_coverage(spark):
    rows = spark.createDataFrame(
        [(0, 90.0, 60), (1, 30.0, 60), (2, 10.0, 0), (3, None, 60), (4, 0.0, 60), (5, 1.0, 3)],
        "i int, t double, s bigint",
    )
    got = [r.y for r in rows.select("i", E.coverage_percent("t", "s").alias("y"))
           .orderBy("i").collect()]
    assert got == [100.0, 50.0, None, None, None, 33.33]


def test_estimated_speakers(scalar):
    assert scalar(E.estimated_speakers("x"), [1, 9, 10, 29, 45, 900], "x bigint") == [
        1, 1, 1, 2, 4, 4]


def test_guest_hint(scalar):
    texts = [
        "A talk with Ann Lee, about featuring things.",
        "Featuring Bob Stone! And more",
        "with Al. featuring Carol Jones.",
        "With Dan With Eve",
        "Nothing here",
        None,
    ]
    hints = scalar(E.guest_hint("x"), texts)
    assert [h and tuple(h) for h in hints] == [
        ("with ", "ann lee"), ("featuring ", "bob stone"), ("featuring ", "carol jones"), None, None, None]


def test_search_is_literal(spark):
    rows = spark.createDataFrame(
        [("a", "50% off", "x"), ("b", "under_score", "y"), ("c", "Plain", "HIT me")],
        "video_id string, title string, description string",
    )
    def found(q):
        hits = rows.where(E.matches_text(q, "title", "description"))
        return sorted(r.video_id for r in hits.collect())

    assert found("%") == ["a"]
    assert found("_") == ["b"]
    assert found("hit") == ["c"]
    assert found("") == ["a", "b", "c"]


def test_file_names(scalar):
    assert scalar(E.transcript_name("x"), ["a.mp3", "a.b.webm", "plain"]) == [
        "a.json", "a.b.json", "plain.json"]
    assert scalar(E.audio_name("x"), ["id1"]) == ["id1.mp3"]


def test_snippet(scalar):
    texts = ["", "x" * 100, "x" * 101]
    assert scalar(X.snippet("x"), texts) == ["", "x" * 100, "x" * 100 + "..."]


def test_confidence_tier_uses_the_unrounded_score(scalar):
    scores = [0.9, 0.9004, 0.7, 0.7001, 0.1]
    assert scalar(X.confidence_tier("x"), scores, "x double") == [
        "medium", "high", "low", "medium", "low"]


def test_one_decimal_rounds_binary_values(scalar):
    assert scalar(X.one_decimal("x"), [0.25, 0.35, 12345.67, 0.0], "x double") == [
        f"{v:.1f}" for v in (0.25, 0.35, 12345.67, 0.0)]


def test_hide_labels(scalar):
    lines = ["[00:01:23] [Speaker 1]: hi", "[12.3] Speaker 1: hi: you", "[12.3] Ann B: hi",
             "# Title: kept", "[0.0] Ann: one\n[3.5] Bob: two"]
    assert scalar(X.hide_labels("x", show_speakers=False), lines) == [
        "hi", "hi: you", "hi", "# Title: kept", "one\ntwo"]
    assert scalar(X.hide_labels("x"), lines[:2]) == ["[Speaker 1]: hi", "Speaker 1: hi: you"]
    assert scalar(X.hide_labels("x", show_timestamps=True), lines) == lines


def test_role_label(spark):
    rows = spark.createDataFrame([(True, False), (False, True), (False, False)], "u boolean, g boolean")
    assert [r.y for r in rows.select(X.role_label(F.col("u"), F.col("g")).alias("y")).collect()] == [
        "UNKNOWN", "GUEST", "HOST"]
