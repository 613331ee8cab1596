"""The data source of raw day folders."""

import datetime as dt

from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from pulselake.sources.day_folders import DayReader, day_folders, new_days


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def stored(root):
    put(root, "2026-09-14/daily_summary.json", '{"calendarDate": "2026-09-14", "totalSteps": 10000}')
    put(root, "2026-09-14/sleep.json", '{"dailySleepDTO": {')
    put(root, "2026-09-14/hrv.json", b"\xff\xfe")
    put(root, "2026-09-14/notes.txt", "no")
    put(root, "2026-09-14/activities/activity_77_summary.json", "{}")
    put(root, "2026-09-14/activities/activity_77.zip", b"PK")
    put(root, "2026-09-14/activities/activity_x1_summary.json", "[1]")
    put(root, "2026-09-14/activities/other.json", "{}")
    put(root, "2026-09-15/daily_summary.json", "")
    put(root, "not-a-day/daily_summary.json", "{}")
    put(root, "2026-13-01/daily_summary.json", "{}")
    put(root, "sample/daily_summary.json", "{}")
    put(root, ".git/config.json", "{}")
    put(root, "stray.json", "{}")
    (root / "2026-09-16").mkdir()


def test_every_file_is_a_row_and_bad_ones_tell_why(spark, tmp_path):
    stored(tmp_path)
    rows = day_folders(spark, f"file://{tmp_path}").collect()
    day = dt.date(2026, 9, 14)
    assert sorted((r.folder, r.kind, r.activity_id, r.package is not None, r.error is not None) for r in rows if r.kind != "activity") == [
        ("2026-09-14", "daily_summary", None, False, False),
        ("2026-09-14", "hrv", None, False, True),
        ("2026-09-14", "sleep", None, False, True),
        ("2026-09-15", "daily_summary", None, False, True),
        ("2026-13-01", "daily_summary", None, False, False),
        ("not-a-day", "daily_summary", None, False, False),
    ]
    acts = {r.activity_id: r for r in rows if r.kind == "activity"}
    assert acts.keys() == {77, None} and acts[77].package.endswith("activity_77.zip") and acts[None].package is None and acts[77].day == day
    assert {r.day for r in rows if r.folder in ("not-a-day", "2026-13-01")} == {None}
    assert [r.payload for r in rows if r.kind == "sleep"] == ['{"dailySleepDTO": {'] and [r.payload for r in rows if r.kind == "hrv"] == [None]


def test_conditions_on_the_day_choose_folders(spark, tmp_path):
    stored(tmp_path)
    root = f"file://{tmp_path}"
    names = lambda *filters: ([*(reader := DayReader(root)).pushFilters(list(filters))], [p.name for p in reader.partitions()])
    first, second, other = dt.date(2026, 9, 14), dt.date(2026, 9, 15), EqualTo(("kind",), "hrv")
    assert names() == ([], ["2026-09-14", "2026-09-15", "2026-09-16", "2026-13-01", "not-a-day"])
    assert names(EqualTo(("day",), second), other) == ([other], ["2026-09-15"])
    assert names(GreaterThanOrEqual(("day",), first), LessThan(("day",), second)) == ([], ["2026-09-14"])
    assert names(In(("day",), (first, dt.date(2026, 9, 16)))) == ([], ["2026-09-14", "2026-09-16"])
    rows = day_folders(spark, root).filter("day = date'2026-09-15'")
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 1
    assert day_folders(spark, root).filter("day > date'2027-01-01'").collect() == []


def test_new_days_come_once(spark, tmp_path):
    root, check = tmp_path / "raw", f"{tmp_path}/check"
    seen = []

    def run():
        sink = lambda batch, _: seen.extend((r.folder, r.kind) for r in batch.collect())
        new_days(spark, f"file://{root}").writeStream.foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)

    stored(root)
    run()
    assert {f for f, _ in seen} == {"2026-09-14", "2026-09-15"} and len(seen) == 6
    put(root, "2026-09-17/sleep.json", "{}")
    run()
    run()
    assert seen[6:] == [("2026-09-17", "sleep")]
