"""Users over ranges of days, sessions and funnels."""

import datetime as dt

from conftest import SMALL
from pyspark.sql import functions as F

from talkgrain.operators import usage


def test_users_of_any_range_without_reading_events_again(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 4000 + 1000 * d, start + dt.timedelta(days=d, seconds=k), "view") for d in range(6) for k in range(8000)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string")
    path = str(tmp_path / "daily")
    for first, last in ((0, 3), (3, 6)):  # later days are added, earlier ones are not read
        part = events.where(F.col("ts").between(start + dt.timedelta(days=first), start + dt.timedelta(days=last, seconds=-1)))
        usage.daily_users(part).write.mode("append").parquet(path)
    daily = spark.read.parquet(path)
    for first, last in ((1, 1), (2, 4), (1, 6)):
        got = usage.users_between(daily, f"2024-01-{first:02d}", f"2024-01-{last:02d}").first()
        exact = len({r[0] for r in rows if first <= r[1].day <= last})
        assert abs(got["users"] - exact) <= 0.05 * exact and got["events"] == 8000 * (last - first + 1)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


ROWS = [(1, at(0), "view", 1), (2, at(5), "click", 1), (3, at(9), "view", 1), (4, at(12), "buy", 1), (5, at(100), "click", 1),
        (6, at(0), "buy", 2), (7, at(1), "view", 2), (8, at(2), "click", 2), (9, at(2), "error", 2), (10, None, "view", 2),
        (11, at(3), "view", None), (12, at(4), "view", 3), (13, at(40), "click", 3)]
EVENTS = "event_id long, ts timestamp, event_type string, user_id long"
STEPS = ("view", "click", "buy")


def told(found):
    return sorted((r["user_id"], r["start"], r["finish"], r["events"], r["reached"]) for r in found.collect())


def test_sessions_and_funnel(spark):
    found = usage.sessions(spark.createDataFrame(ROWS, EVENTS), STEPS)
    assert told(found) == [(1, at(0), at(12), 4, 3), (1, at(100), at(100), 1, 0), (2, at(0), at(2), 4, 2), (3, at(4), at(4), 1, 1),
                           (3, at(40), at(40), 1, 0)]
    got = usage.funnel(found, 3).first()
    assert (got["day"], got["sessions"], got["events"], got["step_1"], got["step_2"], got["step_3"]) == (
        "2024-01-01", 5, 11, 3, 2, 1)


def test_stream_of_sessions_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    steps, gap = ("view", "click", "purchase"), "8 hours"
    last = events.agg(F.max("ts")).first()[0]
    path, out = str(tmp_path / "events"), str(tmp_path / "out")
    days = events.select("*").orderBy("ts").coalesce(1)
    for k in range(3):  # later events come in later files
        days.where(F.dayofmonth("ts") % 31 >= 10 * k).where((F.dayofmonth("ts") % 31 < 10 * (k + 1)) | F.lit(k == 2)).coalesce(
            1).write.mode("append").parquet(path)
    late = events.limit(1).withColumn("ts", F.lit(last + dt.timedelta(days=9))).withColumn("user_id", F.lit(-1).cast(
        dict(events.dtypes)["user_id"]))
    late.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    usage.sessions(stream, steps, gap=gap).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert told(spark.read.parquet(out)) == told(usage.sessions(events, steps, gap=gap))
