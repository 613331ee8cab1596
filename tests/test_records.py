"""Records, defaults, checked seeds, formatted values, the budgeted cascade."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulselake.operators import records, retrieval


def test_sample_values(spark):
    values = [None, 123.0, 45.0, 51.724, 115.25, 108.35, 12345.6, 0.00001234, -0.5, float("nan"), 1e20, 323.05]
    found = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(records.sample_number("v")).collect()]
    assert found == ["NULL", "123", "45", "51.72", "115.2", "108.3", "1.235e+04", "1.234e-05", "-0.5", "NULL", "100000000000000000000", "323.1"]
    blob = spark.createDataFrame([(b"\x00\x01\x02\x03",), (None,), (b"",)], "b binary").select(records.sample_binary(F.col("b"))).collect()
    assert [r[0] for r in blob] == ["<BLOB 4B: 0x00010203...>", "NULL", "<BLOB 0B: 0x...>"]


def test_defaults_fill_every_gap(spark):
    day = lambda k: dt.date(2024, 1, k)
    rows = [("a", day(1), None, 100.0, 900.0, 150.0), ("a", day(2), 60.0, None, None, None), ("a", day(3), None, None, 5000.0, 160.04), ("b", day(1), None, None, None, None)]
    frame = spark.createDataFrame(rows, "s string, day date, resting_heart_rate double, active_kilocalories double, total_kilocalories double, running_avg_hr double")
    found = {(r.s, r.day.day): r for r in records.with_defaults(frame, ["s"], "day").collect()}
    assert [found["a", k].resting_heart_rate for k in (1, 2, 3)] == [60, 60, 60] and found["b", 1].resting_heart_rate == 58
    assert [found["a", k].resting_kilocalories for k in (1, 2, 3)] == [800, 1800, 4700] and found["b", 1].running_avg_hr == 145
    assert [found["a", k].running_avg_hr for k in (1, 2, 3)] == [150, 150, 160]


def test_anomaly_record_rounds_and_leaves_nulls_out(spark):
    frame = spark.createDataFrame([(1, "NORMAL", "", 0.123456, 1.98765, 3.14159, None)], "id int, severity string, factors string, f double, o double, hrv double, rhr double")
    [row] = records.anomaly_records(frame, ["id"], "f", "o", ["hrv", "rhr"]).collect()
    assert (row.is_anomaly, row.isolation_forest_score, row.lof_score, row.metrics) == (False, 0.1235, 1.9877, {"hrv": 3.14})


def test_seeds_with_violations_stop_the_load(spark):
    good = [("system", "s"), ("user", "u"), ("assistant", "\n".join(records.SECTIONS["en"]))]
    rows = [(1, "en", good), (2, "es", good), (3, "en", good[:2]), (4, "en", good[1:] + good[:1]), (5, "en", [])]
    frame = spark.createDataFrame(rows, "id int, lang string, messages array<struct<role:string,content:string>>")
    checked = frame.withColumn("wrong", records.seed_violations(F.col("messages"), F.col("lang")))
    found = {r.id: r.wrong for r in checked.collect()}
    assert found[1] == [] and len(found[2]) == 3 and found[3][:2] == ["turn count", "role order"] and found[4][0] == "role order" and found[5][0] == "turn count"
    assert records.require_valid(checked.filter("id = 1"), "wrong", "id").count() == 1
    with pytest.raises(ValueError, match="2: missing"):
        records.require_valid(checked, "wrong", "id")


def test_response_falls_back(spark):
    rows = [(1, [("user", "q"), ("assistant", "a"), ("assistant", "b")], "r", "c"), (2, [("user", "q")], "r", "c"), (3, None, None, "c"), (4, [], None, None)]
    frame = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>, r string, c string")
    found = {x.id: x.said for x in frame.select("id", records.response_of(F.col("messages"), F.col("r"), F.col("c")).alias("said")).collect()}
    assert found == {1: "a", 2: "r", 3: "c", 4: None}


def test_budget_counts_only_what_reaches_it(spark):
    statuses = ["success", "rejected", "success", "success", "out_of_domain", "no_matching_evidence", "success"]
    frame = spark.createDataFrame(list(enumerate(statuses)), "id long, status string")
    at = F.timestamp_seconds(F.col("id") * 100)
    found = {r.id: (r.status, r.budget) for r in retrieval.within_budget(frame, "id", at, (("short", 450, 2),)).collect()}
    assert found == {0: ("success", "ok"), 1: ("rejected", "not asked"), 2: ("success", "ok"), 3: ("budget_exceeded", "short"), 4: ("out_of_domain", "not asked"), 5: ("no_matching_evidence", "ok"), 6: ("budget_exceeded", "short")}
    empty = {r.id: r.status for r in retrieval.within_budget(frame, "id", at, stored=0).collect()}
    assert empty[0] == "empty_knowledge_base" and empty[1] == "rejected" and empty[5] == "empty_knowledge_base"
