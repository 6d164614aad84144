"""Timelines of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import HOUR, chunked, id_list, placed


def timeline(events: DataFrame) -> DataFrame:
    """Events with their place in their case's order of time; hours are numbered by themselves."""
    return placed(events, ["case_id"], F.floor(F.col("t") / HOUR), [F.col("t"), F.col("seq")]).drop("total_rows")


def grouped(events: DataFrame, column: str, unknown: str) -> DataFrame:
    """Events by user or session in order; null and empty go by the name unknown."""
    name = F.coalesce(F.expr(f"nullif({column}, '')"), F.lit(unknown))
    return events.groupBy("case_id", name.alias(column)).agg(F.count(F.lit(1)).alias("n"), id_list(F.collect_list(F.struct("t", "seq", "event_id"))).alias("event_ids"))


def grouped_chunks(events: DataFrame, column: str, unknown: str, size: int = 1000) -> DataFrame:
    """grouped() in rows of size events each, so that a user or session with any share of the events is many rows and tasks."""
    rows = events.withColumn(column, F.coalesce(F.expr(f"nullif({column}, '')"), F.lit(unknown)))
    return chunked(rows, ["case_id", column], F.floor(F.col("t") / HOUR), [F.col("t"), F.col("seq")], F.col("event_id"), "event_ids", size)


def summary(events: DataFrame) -> DataFrame:
    """total_events, first and last timestamp, users and sessions of each case."""
    order = F.struct("t", "seq")
    name = lambda c, u: F.countDistinct(F.coalesce(F.expr(f"nullif({c}, '')"), F.lit(u)))
    return events.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.min_by("timestamp", order).alias("first"), F.max_by("timestamp", order).alias("last"),
        name("user", "unknown_user").alias("users"), name("session_id", "no_session").alias("sessions"),
    )


def groups(events: DataFrame) -> DataFrame:
    """The user and session groups of each case's timeline: kind, name, events, and the first and last of them in order of time.

    One pass for both kinds; a group is one row of fixed size, whatever its share of the events.
    """
    order = F.struct("t", "seq")
    named = lambda kind, c, none: F.struct(F.lit(kind).alias("kind"), F.coalesce(F.expr(f"nullif({c}, '')"), F.lit(none)).alias("name"))
    rows = events.withColumn("_g", F.explode(F.array(named("user", "user", "unknown_user"), named("session", "session_id", "no_session"))))
    return rows.groupBy("case_id", "_g.kind", "_g.name").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", order).alias("first_event"), F.max_by("event_id", order).alias("last_event"))
