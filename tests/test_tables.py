"""Versioned tables, repairing streams and limited calls."""

import datetime as dt
import random
from threading import Thread

import pytest
from pyspark.sql import functions as F

from pulselake.sources import versioned as V
from pulselake.streaming import limits, repair

SCHEMA = "day date, k long, v string, seq int"


@pytest.fixture
def path(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    V.create(spark, path, SCHEMA, "day")
    return path


def frame(spark, *rows):
    return spark.createDataFrame([(d and dt.date(2024, 1, d), k, v, seq) for d, k, v, seq in rows], SCHEMA)


def held(spark, path, at=None, parts=None):
    return sorted((r.day.day if r.day else 0, r.k, r.v) for r in V.read(spark, path, at, parts).collect())


def files(spark, path, day):
    return sorted(V.snapshot(spark, path).folders.get(f"2024-01-{day:02d}", []))


def test_an_upsert_rewrites_the_files_of_its_days_only(spark, path):
    V.append(frame(spark, (1, 1, "a", 1), (2, 2, "b", 1), (3, 3, "c", 1), (None, 4, "d", 1)), path)
    before = {d: files(spark, path, d) for d in (1, 2, 3)}
    V.upsert(frame(spark, (2, 2, "B", 2), (2, 9, "new", 2)), path, ["day", "k"], ["seq"])
    assert held(spark, path) == [(0, 4, "d"), (1, 1, "a"), (2, 2, "B"), (2, 9, "new"), (3, 3, "c")]
    assert files(spark, path, 1) == before[1] and files(spark, path, 3) == before[3] and files(spark, path, 2) != before[2]
    V.upsert(frame(spark, (2, 2, "old", 0)), path, ["day", "k"], ["seq"])
    assert (2, 2, "B") in held(spark, path)
    V.upsert(frame(spark, (None, 4, "D", 5)), path, ["day", "k"], ["seq"])
    assert (0, 4, "D") in held(spark, path) and len(held(spark, path)) == 5
    with pytest.raises(ValueError):
        V.upsert(frame(spark, (2, 2, "B", 2)), path, ["k"], ["seq"])


def test_readers_keep_the_version_they_opened(spark, path):
    V.append(frame(spark, (1, 1, "a", 1)), path)
    pinned = V.read(spark, path)
    V.overwrite(frame(spark, (5, 7, "z", 1)), path)
    assert [r.v for r in pinned.collect()] == ["a"] and held(spark, path) == [(5, 7, "z")] and held(spark, path, 1) == [(1, 1, "a")] and held(spark, path, 0) == []
    with pytest.raises(ValueError):
        V.snapshot(spark, path, 9)


def test_only_one_of_two_racing_commits_takes_a_number(spark, path):
    assert [V.put_new(spark, f"{path}/log/{1:020d}.json", t) for t in ("{}", "{}")] == [True, False]
    assert V._read_text(spark, f"{path}/log/{1:020d}.json") == "{}"
    assert V.versions(spark, path) == [0, 1]  # what was written beside it is gone


def test_racing_upserts_lose_nothing(spark, path):
    V.append(frame(spark, *[(d, k, "a", 0) for d in (1, 2) for k in range(4)]), path)
    work = lambda k: V.upsert(frame(spark, (1 + k % 2, k, f"w{k}", 1)), path, ["day", "k"], ["seq"])
    threads = [Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert V.versions(spark, path) == list(range(6))
    assert {v for _, _, v in held(spark, path) if v != "a"} == {"w0", "w1", "w2", "w3"} and len(held(spark, path)) == 8


def test_a_change_of_other_days_is_kept_and_of_the_same_day_computed_again(spark, path):
    V.append(frame(spark, (1, 1, "a", 1), (2, 1, "a", 1)), path)
    seen = []

    def change(base):
        seen.append(base.version)
        if len(seen) == 1:
            V.append(frame(spark, (2, 5, "other day", 1)), path)
        if len(seen) == 2:
            raise AssertionError("a change of another day asks for nothing again")
        return {"2024-01-01": []}

    assert V.commit(spark, path, {"2024-01-01"}, change, "delete").version == 3
    assert held(spark, path) == [(2, 1, "a"), (2, 5, "other day")] and seen == [1]
    again = []

    def same(base):
        again.append(base.version)
        if len(again) == 1:
            V.append(frame(spark, (2, 6, "same day", 1)), path)
        return {"2024-01-02": base.folders["2024-01-02"]}

    V.commit(spark, path, {"2024-01-02"}, same, "rewrite")
    assert again == [3, 4] and (2, 6, "same day") in held(spark, path)


def test_batches_count_once_and_days_go_without_reading_them(spark, path):
    for _ in range(2):
        V.append(frame(spark, (1, 1, "a", 1), (20, 2, "b", 1)), path, ("s", 0))
    V.append(frame(spark, (1, 3, "c", 1)), path, ("s", 1), {"mark": "x"})
    V.append(frame(spark, (1, 3, "late replay", 1)), path, ("s", 0))
    V.append(frame(spark, (1, 4, "other stream", 1)), path, ("t", 0))
    assert held(spark, path) == [(1, 1, "a"), (1, 3, "c"), (1, 4, "other stream"), (20, 2, "b")]
    assert V.snapshot(spark, path).marks == {"mark": "x"}
    assert held(spark, path, parts={"2024-01-20"}) == [(20, 2, "b")]
    V.delete_parts(spark, path, lambda day: day >= "2024-01-15")
    assert [r[0] for r in held(spark, path)] == [1, 1, 1]


def test_vacuum_keeps_what_kept_versions_hold(spark, path):
    V.append(frame(spark, (1, 1, "a", 1), (2, 1, "b", 1)), path)
    V.upsert(frame(spark, (1, 1, "A", 2)), path, ["day", "k"], ["seq"])
    gone = V.vacuum(spark, path, keep=1)
    assert len(gone) == 1 and held(spark, path) == [(1, 1, "A"), (2, 1, "b")] and V.versions(spark, path) == [2]


def test_empty_batches_and_odd_partition_names(spark, tmp_path):
    path = f"file://{tmp_path}/odd"
    V.create(spark, path, "name string, n int", "name")
    rows = [("a/b=c %20", 1), ("", 2), (None, 3), ("é漢", 4)]
    V.append(spark.createDataFrame(rows, "name string, n int"), path)
    V.append(spark.createDataFrame([], "name string, n int"), path)
    V.upsert(spark.createDataFrame([("a/b=c %20", 9)], "name string, n int"), path, ["name"], ["n"])
    assert {tuple(r) for r in V.read(spark, path).collect()} == {("a/b=c %20", 9), ("", 2), (None, 3), ("é漢", 4)}


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_late_rows_repair_their_day_or_go_aside(spark, tmp_path):
    base = f"file://{tmp_path}"
    names = [f"{base}/{n}" for n in ("landing", "daily", "late", "checkpoint")]
    event = lambda k, day: (k, day and dt.datetime(2024, 1, 1) + dt.timedelta(days=day - 1), 1, "x", 1.25, None)
    runs = [[event(1, 1), event(2, 20), event(8, 3)], [event(3, 5), event(4, 4), event(5, 21), event(6, None)], []]
    for rows in runs:
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(names[0])
        repair.repair_days(spark, names[0], EVENTS, *names[1:])
    daily = {r.day.day: (r.n, float(r.total)) for r in V.read(spark, names[1]).collect()}
    late = sorted(r.event_id for r in V.read(spark, names[2]).collect())
    assert daily == {1: (1, 1.25), 3: (1, 1.25), 5: (1, 1.25), 20: (1, 1.25), 21: (1, 1.25)} and late == [4, 6]
    assert V.snapshot(spark, names[1]).marks == {repair.NEWEST: "2024-01-21"}
    # a batch that fails between its two tables is split again as before
    sink, batch = repair.repairing_sink(names[1], names[2], "events"), spark.createDataFrame([event(10, 6), event(11, 40), event(12, 2)], EVENTS)
    rows = batch.withColumn("day", F.to_date("ts"))
    V.append(rows.filter("event_id = 12"), names[2], ("events", 9))
    for _ in range(2):
        sink(batch, 9)
    assert {r.day.timetuple().tm_yday for r in V.read(spark, names[1]).collect()} == {1, 3, 5, 6, 20, 21, 40}
    assert sorted(r.event_id for r in V.read(spark, names[2]).collect()) == [4, 6, 12]


LIMITS = (("short", 60, 2), ("hour", 3600, 5), ("day", 86400, 9))


def plain_limits(times):
    accepted, out = [], []
    for at in times:
        full = [name for name, seconds, most in LIMITS if len([a for a in accepted if at - a < seconds]) >= most]
        out.append(full[0] if full else "ok")
        if not full:
            accepted.append(at)
    return out


def calls_of(spark, seed):
    rng, rows = random.Random(seed), []
    for user in (1, 2, None):
        at = 0
        for k in range(150):
            at += rng.choice([0, 1, 20, 59, 60, 600, 3600, 86_399, 86_400])
            rows.append((1000 * (user or 0) + k, user, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), at))
    return rows


def want(rows):
    out = {}
    for user in {r[1] for r in rows}:
        mine = sorted((at, k) for k, u, _, at in rows if u == user)
        out |= {(user, k): o for (_, k), o in zip(mine, plain_limits([at for at, _ in mine]))}
    return out


def test_three_limits_over_a_table(spark):
    rows = calls_of(spark, 1)
    frame = spark.createDataFrame([r[:3] for r in rows], "event_id long, user_id long, ts timestamp")
    found = {(r.user_id, r.event_id): r.outcome for r in limits.limited_table(frame, "user_id", LIMITS).collect()}
    assert found == want(rows) and set(found.values()) == {"ok", "short", "hour", "day"}
    assert limits.limited_table(frame.limit(0), "user_id").collect() == []
    [row] = limits.limited_table(spark.createDataFrame([(1, 1, None)], frame.schema), "user_id").collect()
    assert row.outcome == "ok"


def test_a_stream_in_any_order_decides_as_the_table(spark, tmp_path):
    rows = calls_of(spark, 2)
    rng, landing = random.Random(3), f"{tmp_path}/landing"
    schema = "event_id long, user_id long, ts timestamp"
    end = max(r[2] for r in rows)
    batches = [[], [], []]
    for r in rows:  # up to a day late
        place = min(2, int((r[2] - dt.datetime(2024, 1, 1)) / (end - dt.datetime(2024, 1, 1)) * 3))
        batches[min(2, place + (rng.random() < 0.3))].append(r[:3])
    V.create(spark, f"file://{tmp_path}/out", "user_id long, event_id long, ts timestamp, outcome string", "outcome")
    for batch in [*batches, [(-1, -1, end + dt.timedelta(days=400))]]:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(landing)
        with limits.keyed_state(spark):
            stream = limits.limited_stream(repair.landed(spark, landing, schema), "user_id", LIMITS, lateness="200 days")
            repair.catch_up(stream, f"{tmp_path}/checkpoint", repair.closing_sink(f"file://{tmp_path}/out", "calls"))
    found = {(r.user_id, r.event_id): r.outcome for r in V.read(spark, f"file://{tmp_path}/out").collect()}
    assert found == want(rows)
    # nothing is left of users whose last call is a day ago: only the closing call waits
    state = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "accepted").option("flattenCollectionTypes", True).load()
    assert state.isEmpty()
    waiting = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "waiting").option("flattenCollectionTypes", True).load()
    assert [r.key.user_id for r in waiting.collect()] == [-1]
