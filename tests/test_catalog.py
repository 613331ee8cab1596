"""Keys and links, table functions, payloads as variants."""

import datetime as dt
import json

import pytest

from pulselake.functions import table_functions
from pulselake.operators import keys, payloads


def test_keys_and_links_of_small_tables(spark):
    parent = spark.createDataFrame([(k, f"n{k}", k % 2, None if k == 3 else k) for k in range(50)], "id long, name string, odd int, gap int")
    child = spark.createDataFrame([(k % 7, k // 7, f"n{k % 50}", k % 49, k + 10) for k in range(70)] + [(None, 99, None, None, None)], "a int, b int, name string, ref int, far int")
    empty = spark.createDataFrame([], "x long, y string")
    pairs = spark.createDataFrame([(a, b, 1.5) for a in range(9) for b in range(8)], "a int, b int, v double")
    tables = {"parent": parent, "child": child, "empty": empty, "pairs": pairs}
    assert sorted(keys.keys(tables)) == [("pairs", ("a", "b")), ("parent", ("id",)), ("parent", ("name",))]
    found = {(r.child, r.child_column, r.parent, r.parent_column): r.n_values for r in keys.links(tables).collect()}
    assert found == {("child", "a", "parent", "id"): 7, ("child", "name", "parent", "name"): 50, ("child", "ref", "parent", "id"): 49, ("pairs", "a", "parent", "id"): 9, ("pairs", "b", "parent", "id"): 8}
    assert keys.links({"empty": empty}).collect() == []


def test_one_stranger_breaks_a_link_however_large_the_tables(spark, monkeypatch):
    monkeypatch.setattr(keys, "SAMPLE", 16)  # so few samples that the exact step has to see it
    parent, child = spark.range(20_000).withColumnRenamed("id", "p"), spark.range(20_000).selectExpr("if(id = 777, 20000, id) c")
    assert keys.links({"parent": parent, "child": child}).collect() == []
    assert [r.n_values for r in keys.links({"parent": parent, "child": spark.range(5000).selectExpr("id % 1000 c")}).collect()] == [1000]


def test_repeated_values_and_nulls_are_no_keys(spark):
    nearly = spark.range(10_000).selectExpr("if(id = 5, 6, id) k", "if(id = 5, null, id) n")
    assert keys.keys({"t": nearly}) == []
    assert keys.keys({"t": spark.range(0)}) == []


@pytest.fixture
def days(spark):
    table_functions.register(spark)
    day = lambda d: dt.date(2024, 1, d)
    rows = [("a", day(d), float(d) if d <= 10 else None) for d in range(1, 21)] + [("b", day(1), None), ("b", day(2), None), ("c", day(5), 1.0), ("c", day(5), 3.0), ("d", None, 1.0)]
    return spark.createDataFrame(rows, "series string, day date, v double")


def asked(spark, days, more):
    found = {}
    for r in spark.sql(f"SELECT * FROM recent_actuals(TABLE({{days}}) PARTITION BY series ORDER BY day, {more})", days=days).collect():
        found.setdefault(r.series, []).append(r)
    return found


def test_actuals_end_at_the_last_day_with_a_value(spark, days):
    found = asked(spark, days, "value => 'v', days => 3")
    a, summary = found["a"][:-1], found["a"][-1]
    assert [(r.day.day, r.value) for r in a] == [(8, 8.0), (9, 9.0), (10, 10.0)]
    assert (summary.status, summary.first_day.day, summary.last_day.day, summary.records, summary.mean) == ("success", 8, 10, 3, 9.0)
    assert [r.day.day for r in found["b"][:-1]] == [1, 2] and found["b"][-1].mean is None
    assert found["c"][-1].records == 2 and found["d"][-1].status == "empty" and found["d"][-1].records == 0
    assert len(asked(spark, days, "value => 'v', days => 0")["a"]) == 2 and asked(spark, days, "value => 'v', days => 500")["a"][-1].records == 10


def test_wrong_arguments_fail_while_the_query_is_planned(spark, days):
    for more in ("value => 'no such', days => 3", "value => 'v', days => 3, other => 1"):
        with pytest.raises(Exception, match="no column|REQUIRED|UNRECOGNIZED|unexpected|argument"):
            asked(spark, days, more)
    with pytest.raises(Exception, match="horizon|metric"):
        spark.sql("SELECT * FROM forecasts_ahead(TABLE({days}) PARTITION BY series ORDER BY day, base => DATE'2024-01-01', horizon => 0)", days=days).collect()


def test_payloads_are_parsed_once_and_bad_ones_stay(spark):
    texts = ['{"env": {"x": 5, "y": {"z": "t"}}, "x": 1}', '{"x": 2}', '[{"x": 3}, {"x": 4}]', '{"x":', "", None, "7", "[]", '{"x": "no number"}', '{"env": null, "x": 6}', json.dumps({"x": 1, "big": "a" * 100_000})]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, p string")
    frame = payloads.parsed(rows, "p", "env", {"x": ("$.x", "bigint"), "z": ("$.y.z", "string"), "again": ("$.x", "string")})
    found = {r.id: r for r in frame.collect()}
    assert len(found) == len(texts) and [found[k].x for k in range(11)] == [5, 2, 3, None, None, None, None, None, None, 6, 1]
    assert [found[k].shape for k in range(11)] == ["envelope", "bare", "list", None, None, None, "other", "list", "bare", "bare", "bare"]
    assert [k for k in range(11) if found[k].error] == [3, 4] and found[0].z == "t" and found[8].again == "no number"
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1, plan
    assert tuple(payloads.payload_schema(rows.filter("id in (1, 3, 9)"), "p").first())[1:] == (2, 1)
    assert "x: BIGINT" in payloads.payload_schema(rows.filter("id in (1, 3)"), "p").first().schema
