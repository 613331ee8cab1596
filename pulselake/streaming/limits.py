"""Calls limited in several sliding windows at once: one fold over tables and streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: (name, seconds, accepted calls at most): a client's own limit, the hourly and the daily budget.
LIMITS = (("minute", 60, 15), ("hour", 3600, 60), ("day", 86400, 100))
Windows = tuple[tuple[str, int, int], ...]
SECOND = 1_000_000
OK = "ok"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(at: int, accepted: list[int], limits: Windows) -> str:
    """The first window that is full at a time (microseconds), or ``ok``; a call a whole window ago no longer counts."""
    return next((name for name, seconds, most in limits if sum(a > at - seconds * SECOND for a in accepted) >= most), OK)


def fold(times: list[int], accepted: list[int], limits: Windows) -> tuple[list[str], list[int]]:
    """Outcomes of calls in order of time, and the accepted calls that still count behind the last."""
    longest, out = max(s for _, s, _ in limits) * SECOND, []
    for at in times:
        accepted = [a for a in accepted if a > at - longest]
        out.append(decide(at, accepted, limits))
        if out[-1] == OK:
            accepted.append(at)
    return out, accepted


class LimitedCalls(StatefulProcessor):
    """A user's calls wait until the watermark has passed them, and are then decided in order of time and id.

    State is the waiting calls and the accepted ones; a timer decides, and another clears what
    is left when the longest window has passed since the last accepted call.
    """

    def __init__(self, user: str, limits: Windows):
        self.user, self.limits = user, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.accepted = handle.getListState("accepted", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        calls = [(r["at"], r["event_id"]) for r in rows]
        self.waiting.appendList(calls)
        self.handle.registerTimer(_millis(min(at for at, _ in calls)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due, later = [w for w in waiting if w[0] <= passed], [w for w in waiting if w[0] > passed]
        outcomes, accepted = fold([at for at, _ in due], [r[0] for r in self.accepted.get()], self.limits)
        longest = max(s for _, s, _ in self.limits) * SECOND
        accepted = [a for a in accepted if a > passed - longest]
        for state, left, until in ((self.waiting, later, 0), (self.accepted, [(a,) for a in accepted], longest)):
            state.clear()
            if left:
                state.put(left)
                self.handle.registerTimer(_millis((left[0] if state is self.waiting else left[-1])[0] + until))
        for (at, event_id), outcome in zip(due, outcomes):
            yield Row(**{self.user: key[0], "event_id": event_id, "at": at, "outcome": outcome})

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    return -(-micros // 1000)


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that are started inside keep their state in the store that lists and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def limited_stream(calls: DataFrame, user: str, limits: Windows = LIMITS, lateness: str = "1 hour") -> DataFrame:
    """(user, event_id, ts, outcome) of a stream of calls; outcomes are those of the table of all calls.

    A call is decided once no earlier one can come (``lateness`` is the watermark); a call that
    comes later still is left out. Start the query inside ``keyed_state``.
    """
    rows = calls.select(F.col(user).cast("long").alias(user), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null")
    rows = rows.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    schema = f"{user} long, event_id long, at long, outcome string"
    found = rows.groupBy(user).transformWithState(LimitedCalls(user, limits), schema, "Append", "EventTime")
    return found.select(user, "event_id", F.timestamp_micros("at").alias("ts"), "outcome")


def limited_table(calls: DataFrame, user: str, limits: Windows = LIMITS) -> DataFrame:
    """(user, event_id, ts, outcome) of a table of calls; rejected calls do not count. Calls without a time have no limit.

    A user's calls are cut into stretches that lie the longest window or more apart and do not
    depend on each other; a stretch is sorted in its partition and folded as it goes by, so a
    task holds the accepted calls of one window at most.
    """
    longest = max(s for _, s, _ in limits) * SECOND
    ts = F.col("ts").cast("timestamp")
    rows = calls.select(F.col(user).cast("long").alias(user), F.col("event_id").cast("long").alias("event_id"), ts.alias("ts"), F.unix_micros(ts).alias("_at"))
    rows = rows.withColumn("_slot", F.floor(F.col("_at") / longest))
    # a gap of the longest window lies between two slots of its length, so slots and their ends tell where stretches begin
    slots = rows.filter("_at is not null").groupBy(user, "_slot").agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    by_slot = Window.partitionBy(user).orderBy("_slot")
    begins = F.when(F.col("lo") - F.lag("hi").over(by_slot) >= longest, F.col("_slot"))
    first = F.last(F.col("_begins"), ignorenulls=True).over(by_slot.rowsBetween(Window.unboundedPreceding, 0))
    cut = slots.withColumn("_begins", begins).select(F.col(user).alias("_user"), F.col("_slot").alias("_on"), first.alias("_stretch"))
    placed = rows.join(cut, F.col(user).eqNullSafe(F.col("_user")) & (F.col("_slot") == F.col("_on")), "left").select(user, "event_id", "ts", "_at", "_stretch")
    placed = placed.repartition(user, "_stretch").sortWithinPartitions(user, "_stretch", F.col("_at").asc_nulls_last(), "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, accepted = None, []
        for batch in batches:
            out = []
            for u, at, stretch in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                if key != (u, stretch):
                    key, accepted = (u, stretch), []
                if at is None:
                    out.append(OK)
                    continue
                [outcome], accepted = fold([at], accepted, limits)
                out.append(outcome)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=[user, "event_id", "ts", "outcome"])

    return placed.mapInArrow(run, f"{user} long, event_id long, ts timestamp, outcome string")
