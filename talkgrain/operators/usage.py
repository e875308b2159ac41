"""Who uses what: users over any range of days, sessions and the steps taken in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a distinct-count sketch: 2 ** 12 registers have a standard error of 1.6 %.
REGISTERS = 12


def daily_users(events: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """(day, event_type, events, users): ``users`` is a sketch of the distinct users, merged map-side. A day's
    rows never change when later days are added."""
    return events.where("ts is not null").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(
        F.count("*").alias("events"), F.hll_sketch_agg("user_id", registers).alias("users"))


def users_between(daily: DataFrame, first: str, last: str) -> DataFrame:
    """(event_type, events, users) of the days from ``first`` to ``last``, from their sketches alone."""
    return daily.where(F.col("day").between(first, last)).groupBy("event_type").agg(
        F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


def users_by(daily: DataFrame, group) -> DataFrame:
    """The same per value of ``group``, a column over day, such as its month."""
    return daily.groupBy(group.alias("period"), "event_type").agg(
        F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


def sessions(events: DataFrame, steps: Sequence[str], *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, finish, events, reached) of each session, the events of a user with less than ``gap``
    between them. ``reached`` counts the ``steps``, event types, that were taken in their order, others
    between them or not. On a stream a session comes out when ``late`` has passed after it."""
    step = F.lit(None).cast("int")
    for k, name in enumerate(steps):
        step = F.when(F.col("event_type") == name, k + 1).otherwise(step)
    rows = events.where("ts is not null and user_id is not null").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", step.alias("step"))
    # Only events that are steps are held until the end of their session.
    taken = F.sort_array(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("ts", "event_id", "step"))))
    grouped = rows.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("events"), F.max("ts").alias("finish"), taken.alias("taken"))
    reached = F.aggregate("taken", F.lit(0), lambda at, t: F.when(t["step"] == at + 1, at + 1).otherwise(at))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "finish", "events",
                          reached.alias("reached"))


def funnel(found: DataFrame, steps: int) -> DataFrame:
    """(day, sessions, events, step_1, step_2, ...): sessions by the day they start, and how many took each step."""
    return found.groupBy(F.date_format("start", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("sessions"), F.sum("events").alias("events"),
        *(F.sum((F.col("reached") >= k).cast("bigint")).alias(f"step_{k}") for k in range(1, steps + 1)))
