"""Structured Streaming forms: closed days, sessions, idempotent upserts, call budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from pulselake.sources import versioned
from pulselake.streaming.limits import OK, SECOND, fold, limited_stream, limited_table


def closed_days(events: DataFrame, lateness: str = "15 days") -> DataFrame:
    """Counts and sums per day and kind; a day is emitted once no later event may change it.

    Works on streams (append mode, ``lateness`` is the watermark) and on tables alike.
    """
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    day = F.window("ts", "1 day")
    return rows.groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(
        F.col("w.start").cast("date").alias("day"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Sessions per user: runs of events less than ``gap`` apart."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")).select(
        "user_id", F.col("s.start").alias("first_ts"), "last_ts", "n"
    )


def upsert_into(path: str, keys: list[str], order: list[str], part: str, stream: str = "upserts") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into the versioned table at ``path``: the batch's partitions only.

    ``keys`` hold ``part``. The table keeps the stream's last batch, so replays change nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        versioned.create(batch.sparkSession, path, batch.schema, part)
        versioned.upsert(batch, path, keys, order, (stream, number))

    return write


def budget_fold(times: list[float], hour: int, day: int, accepted: list[float]) -> tuple[list[bool], list[float]]:
    """Accepts a call (seconds) while fewer than ``hour`` (``day``) accepted calls lie in the last 3600 (86400) seconds."""
    micros = lambda some: [round(t * SECOND) for t in some]
    outcomes, left = fold(micros(times), micros(accepted), (("hour", 3600, hour), ("day", 86400, day)))
    return [o == OK for o in outcomes], [a / SECOND for a in left]


def call_budget(calls: DataFrame, user: str, hour: int = 60, day: int = 100) -> DataFrame:
    """(user, event_id, ts, accepted): calls of an hourly and a daily budget; rejected ones do not count, those without a time have no limit.

    Streams (inside ``limits.keyed_state``) and tables alike; ``streaming.limits`` has the fold, its state and its stretches.
    """
    windows = (("hour", 3600, hour), ("day", 86400, day))
    found = limited_stream(calls, user, windows) if calls.isStreaming else limited_table(calls, user, windows)
    return found.select(user, "event_id", "ts", (F.col("outcome") == OK).alias("accepted"))
