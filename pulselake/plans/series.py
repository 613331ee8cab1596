"""Queries over series: windows, fills, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.operators import stats, windows
from pulselake.operators.consolidate import cents
from pulselake.operators.quantiles import with_quantiles
from pulselake.plans.common import DAILY, ORDERS, daily, order_series
from pulselake.plans.registry import query
from pulselake.session import table

#: (user_id, day, value): clicks per user on a dense calendar, so that gaps are nulls.
DENSE = f"""{DAILY}, clicks AS (SELECT user_id, day, CAST(value AS DOUBLE) AS value FROM daily WHERE metric = 'click'),
span AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM clicks GROUP BY user_id),
dense AS (SELECT span.user_id, span.day, clicks.value FROM span LEFT JOIN clicks ON clicks.user_id = span.user_id AND clicks.day = span.day)"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = daily(spark, sf_dir).filter("metric = 'click'").select("user_id", "day", F.col("value").cast("double").alias("value"))
    return windows.dense_calendar(clicks, ["user_id"], "day")


#: (day, price, shipped): orders and shipments per day and return flag, the lagged pair.
PAIRED = """o AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1),
l AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1, 2),
paired AS (SELECT flag, l.day, CAST(o.v AS DOUBLE) AS price, CAST(l.v AS DOUBLE) AS shipped FROM l JOIN o ON o.day = l.day)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    o = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(cents("o_totalprice")).cast("double").alias("price"))
    shipped = items.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(cents("l_extendedprice")).cast("double").alias("shipped"))
    return shipped.join(o, "day").select("flag", "day", "price", "shipped")


def _mean(rows: int, column: str = "value") -> str:
    over = f"OVER (PARTITION BY priority ORDER BY day ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CAST(sum({column}) {over} AS DOUBLE) / count({column}) {over}"


@query(f"WITH {ORDERS} SELECT priority, day, {_mean(7)} AS roll7, {_mean(3)} AS roll3 FROM series")
def f1_rolling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the last 3 and 7 rows of each series."""
    rows = order_series(spark, sf_dir)
    return rows.select("priority", "day", *[windows.rolling_rows("value", ["priority"], "day", n).alias(f"roll{n}") for n in (7, 3)])


@query(f"WITH {ORDERS} SELECT priority, day, round({_mean(3)} / ({_mean(7)} + 0.0001), 6) AS acwr FROM series")
def f3_acwr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acute to chronic ratio of each series."""
    return order_series(spark, sf_dir).select("priority", "day", F.round(windows.acwr("value", ["priority"], "day", 1e-4), 6).alias("acwr"))


@query(f"""
WITH {DENSE}
SELECT user_id, day, value,
  coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lag1
FROM dense
""")
def f4_lag_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previous day's value, filled forward and then backward, on a dense calendar."""
    return dense(spark, sf_dir).withColumn("lag1", windows.lag_filled("value", ["user_id"], "day"))


@query(f"""
WITH {DENSE}
SELECT user_id, day,
  coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
FROM dense
""")
def f5_ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward, then backward fill on a dense calendar."""
    return dense(spark, sf_dir).select("user_id", "day", windows.fill_both("value", ["user_id"], "day").alias("filled"))


@query(f"""
WITH {DAILY}, c AS (SELECT user_id, day, value FROM daily WHERE metric = 'click')
SELECT user_id, day, CAST(sum(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS DOUBLE) AS past_week
FROM c
""")
def f6_rolling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over the seven calendar days before each row, gaps and all."""
    rows = daily(spark, sf_dir).filter("metric = 'click'")
    return rows.select("user_id", "day", windows.rolling_days("value", ["user_id"], "day", -7, -1).cast("double").alias("past_week"))


@query(f"""
WITH {DENSE}, i AS (SELECT *, row_number() OVER w AS i FROM dense WINDOW w AS (PARTITION BY user_id ORDER BY day)),
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM i)
SELECT user_id, day, round(CASE WHEN pi < ni THEN pv + (nv - pv) / (ni - pi) * (i - pi) ELSE coalesce(pv, nv) END, 6) AS value FROM n
""")
def f7_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation by row position."""
    rows = windows.interpolate(dense(spark, sf_dir), "value", ["user_id"], "day", "out")
    return rows.select("user_id", "day", F.round("out", 6).alias("value"))


@query("""
SELECT o_orderpriority AS priority, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS least,
       round(quantile_cont(o_totalprice, 0.5), 6) AS median, max(o_totalprice) AS greatest
FROM orders GROUP BY 1
""")
def e10_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample deviation, minimum, exact median and maximum per series."""
    c = "o_totalprice"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), c)
    found = rows.groupBy("priority").agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("least"), F.max(c).alias("greatest"))
    return with_quantiles(found, rows, c, ["priority"], [0.5]).withColumn("median", F.round(F.col("q")[0], 6)).drop("q")


def _tukey_sql(table_: str, value: str, by: str, k: float) -> str:
    return f"""
WITH q AS (SELECT {by} AS grp, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3 FROM {table_} GROUP BY 1)
SELECT grp, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - {k} * (q3 - q1), 6) AS lo, round(q3 + {k} * (q3 - q1), 6) AS hi,
  count(*) FILTER (WHERE {value} < q1 - {k} * (q3 - q1) OR {value} > q3 + {k} * (q3 - q1)) AS outliers
FROM {table_} JOIN q ON grp = {by} GROUP BY ALL"""


def _tukey(spark: SparkSession, sf_dir: str, name: str, value: str, by: str, k: float) -> DataFrame:
    found = stats.tukey_fences(table(spark, sf_dir, name).select(F.col(by).alias("grp"), value), value, k, ["grp"])
    return found.select("grp", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "lo", "hi")], "outliers")


@query(_tukey_sql("orders", "o_totalprice", "o_orderpriority", 1.5))
def g1_tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences at 1.5 interquartile ranges."""
    return _tukey(spark, sf_dir, "orders", "o_totalprice", "o_orderpriority", 1.5)


@query(_tukey_sql("lineitem", "l_extendedprice", "l_returnflag", 2.5))
def g2_tukey_2_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences at 2.5 interquartile ranges."""
    return _tukey(spark, sf_dir, "lineitem", "l_extendedprice", "l_returnflag", 2.5)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]))
def g4_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of all pairs of measures in one pass."""
    return stats.pearson_pairs(table(spark, sf_dir, "lineitem"), _MEASURES).withColumn("r", F.round("r", 6))


def _ccf_sql() -> str:
    lags = [(k, f"z1 * {'lag' if k > 0 else 'lead'}(z2, {abs(k)}) OVER w" if k > 0 else f"z1 * lag(z2, {-k}) OVER w" if k < 0 else "z1 * z2") for k in range(-3, 4)]
    # a negative lag pairs the first series with later values of the second
    lags = [(k, e.replace("lag(z2", "lead(z2") if k < 0 else e) for k, e in lags]
    shifted = ", ".join(f"{e} AS l{k + 3}" for k, e in lags)
    union = " UNION ALL ".join(f"SELECT flag, CAST({k} AS INTEGER) AS lag, avg(l{k + 3}) AS r FROM s GROUP BY flag" for k, _ in lags)
    return f"""{PAIRED}, z AS (SELECT flag, day, (price - avg(price) OVER p) / (stddev_pop(price) OVER p + 1e-6) AS z1, (shipped - avg(shipped) OVER p) / (stddev_pop(shipped) OVER p + 1e-6) AS z2
  FROM paired WINDOW p AS (PARTITION BY flag)), s AS (SELECT flag, {shifted} FROM z WINDOW w AS (PARTITION BY flag ORDER BY day)), c AS ({union})"""


@query(f"WITH {_ccf_sql()} SELECT flag, lag, round(r, 6) AS r FROM c")
def g5_ccf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-correlation of orders and shipments per return flag at lags -3 to 3."""
    return stats.cross_correlation(paired(spark, sf_dir), "price", "shipped", ["flag"], "day").withColumn("r", F.round("r", 6))


@query(f"WITH {_ccf_sql()} SELECT flag, arg_max(lag, (abs(r), -lag)) AS peak_lag, round(arg_max(r, (abs(r), -lag)), 6) AS peak_r FROM c GROUP BY flag")
def g5_ccf_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag at which orders and shipments go together most."""
    correlations = stats.cross_correlation(paired(spark, sf_dir), "price", "shipped", ["flag"], "day")
    return stats.ccf_peak(correlations, ["flag"]).withColumn("peak_r", F.round("peak_r", 6))


@query(f"""
WITH {PAIRED}, l1 AS (SELECT flag, shipped AS y, lag(shipped) OVER w AS y1, lag(price) OVER w AS x1 FROM paired WINDOW w AS (PARTITION BY flag ORDER BY day)),
s AS (SELECT flag, count(*) AS t, count(*) * covar_pop(y, y) AS yy, count(*) * covar_pop(y, y1) AS y1y, count(*) * covar_pop(y1, y1) AS y11,
  count(*) * covar_pop(y, x1) AS x1y, count(*) * covar_pop(x1, x1) AS x11, count(*) * covar_pop(y1, x1) AS xy1 FROM l1 WHERE y1 IS NOT NULL GROUP BY flag),
r AS (SELECT flag, t, yy - y1y * y1y / y11 AS ssr_r, (x1y - xy1 * y1y / y11) * (x1y - xy1 * y1y / y11) / (x11 - xy1 * xy1 / y11) AS gain FROM s)
SELECT flag, t, round(gain / ((ssr_r - gain) / (t - 3)), 6) AS f_stat FROM r
""")
def g6_granger_f_lag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granger's F at lag 1: do orders help to predict shipments?"""
    return stats.granger_lag1(paired(spark, sf_dir), "price", "shipped", ["flag"], "day").select("flag", "t", F.round("f_stat", 6).alias("f_stat"))


@query(f"""
WITH {ORDERS}, a AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY day) AS i, count(*) OVER (PARTITION BY priority) AS total,
  CAST(lag(value, 7) OVER (PARTITION BY priority ORDER BY day) AS DOUBLE) AS p, CAST(value AS DOUBLE) AS y FROM series)
SELECT priority, count(*) AS k, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs((y - p) / (y + 1e-6))) * 100, 6) AS mape
FROM a WHERE i > total - 14 GROUP BY priority
""")
def g21_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a seasonal-naive forecast on the last fourteen rows of each series."""
    from pulselake.operators.forecast import holdout_metrics

    return holdout_metrics(order_series(spark, sf_dir), "value", ["priority"], "day", 14, 7)


@query("""
SELECT event_id, dayname(ts) AS day_name, CAST(isodow(ts) - 1 AS INTEGER) AS dow, isodow(ts) >= 6 AS weekend FROM events
""")
def g26_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day name, weekday (Monday 0) and weekend flag."""
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(ts, "EEEE").alias("day_name"), F.weekday(ts).alias("dow"), (F.weekday(ts) >= 5).alias("weekend"))


@query(f"""
WITH {DAILY}, t AS (SELECT user_id, day, sum(value) AS total, sum(value) FILTER (WHERE metric = 'click') AS deep, sum(value) FILTER (WHERE metric = 'view') AS rem,
  CAST(sum(value) FILTER (WHERE metric = 'error') AS DOUBLE) AS base FROM daily GROUP BY 1, 2)
SELECT user_id, day, round(CAST(deep AS DOUBLE) / (CAST(total AS DOUBLE) + 1e-6), 6) AS deep_ratio, round(CAST(rem AS DOUBLE) / (CAST(total AS DOUBLE) + 1e-6), 6) AS rem_ratio,
  round(CAST(deep AS DOUBLE) / nullif(base, 0), 6) AS to_baseline FROM t
""")
def g27_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio features that are safe at zero."""
    of = lambda k: F.sum(F.when(F.col("metric") == k, F.col("value"))).cast("double")
    rows = daily(spark, sf_dir).groupBy("user_id", "day").agg(F.sum("value").cast("double").alias("total"), of("click").alias("deep"), of("view").alias("rem"), of("error").alias("base"))
    share = lambda c: F.round(F.col(c) / (F.col("total") + F.lit(1e-6)), 6)
    return rows.select("user_id", "day", share("deep").alias("deep_ratio"), share("rem").alias("rem_ratio"), F.round(F.col("deep") / F.nullif("base", F.lit(0.0)), 6).alias("to_baseline"))


@query(f"""
WITH {DENSE}, f AS (SELECT user_id, day, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 58) AS v FROM dense)
SELECT user_id, day, greatest(v, 20.0) AS value FROM f
""")
def g29_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward fill, then a domain default, then a floor."""
    filled = F.coalesce(windows.forward_fill("value", ["user_id"], "day"), F.lit(58.0))
    return dense(spark, sf_dir).select("user_id", "day", F.greatest(filled, F.lit(20.0)).alias("value"))


@query(f"""
WITH {DAILY}, m AS (SELECT user_id, day, CAST(sum(value) FILTER (WHERE metric = 'click') AS DOUBLE) AS hrv, CAST(sum(value) FILTER (WHERE metric = 'view') AS DOUBLE) AS rhr FROM daily GROUP BY 1, 2),
z AS (SELECT user_id, day, (hrv - avg(hrv) OVER p) / (stddev_pop(hrv) OVER p + 1e-6) AS zh, (rhr - avg(rhr) OVER p) / (stddev_pop(rhr) OVER p + 1e-6) AS zr FROM m WINDOW p AS (PARTITION BY user_id))
SELECT user_id, day, concat_ws('; ', CASE WHEN zh < -1.5 THEN 'low HRV' END, CASE WHEN zr > 1.5 THEN 'high RHR' END) AS factors,
  CASE WHEN coalesce(zh < -1.5, false) AND coalesce(zr > 1.5, false) THEN 'ACUTE_ALERT' WHEN coalesce(zh < -1.5, false) OR coalesce(zr > 1.5, false) THEN 'MILD_ANOMALY' ELSE 'NORMAL' END AS severity
FROM z
""")
def g14_rule_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule factors from z-scores, and the severity that they add up to."""
    from pulselake.operators.anomaly import rule_factors, severity

    of = lambda k: F.sum(F.when(F.col("metric") == k, F.col("value"))).cast("double")
    rows = daily(spark, sf_dir).groupBy("user_id", "day").agg(of("click").alias("hrv"), of("view").alias("rhr"))
    rules = [("hrv", "<", -1.5, "low HRV"), ("rhr", ">", 1.5, "high RHR")]
    found = rule_factors(rows, rules, ["user_id"])
    return found.select("user_id", "day", F.concat_ws("; ", "factors").alias("factors"), severity(F.size("factors"), F.lit(0)).alias("severity"))
