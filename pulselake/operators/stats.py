"""Statistics over series as aggregates and windows: fences, correlation, lags, Granger's F."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulselake.operators.quantiles import exact_quantiles


def tukey_fences(rows: DataFrame, value: str, k: float, by: list[str]) -> DataFrame:
    """Quartiles, fences at ``k`` interquartile ranges and the number of rows outside, per group.

    Quantiles are exact and linearly interpolated; groups may be of any size.
    """
    fences = exact_quantiles(rows, value, by, [0.25, 0.75]).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    fences = fences.withColumn("lo", F.col("q1") - k * (F.col("q3") - F.col("q1"))).withColumn("hi", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    outside = (F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi"))
    return rows.join(fences, by).groupBy(*by).agg(*[F.first(c).alias(c) for c in ("q1", "q3", "lo", "hi")], F.count(F.when(outside, 1)).alias("outliers"))


def pearson_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns in one aggregate; nulls are dropped pairwise."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]
    return rows.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def z_score(column: str, by: list[str], epsilon: float = 1e-6) -> Column:
    """Population z-score within the series."""
    w = Window.partitionBy(*by)
    return (F.col(column) - F.avg(column).over(w)) / (F.stddev_pop(column).over(w) + F.lit(epsilon))


def cross_correlation(rows: DataFrame, first: str, second: str, series: list[str], order: str, max_lag: int = 3) -> DataFrame:
    """(series, lag, r): mean product of z-scores where they overlap; negative lag means that ``first`` leads."""
    w = Window.partitionBy(*series).orderBy(order)
    z = rows.withColumn("_x", z_score(first, series)).withColumn("_y", z_score(second, series))
    lags = list(range(-max_lag, max_lag + 1))
    shifted = z.select(*series, *[(F.col("_x") * (F.lead("_y", -k).over(w) if k < 0 else F.lag("_y", k).over(w) if k else F.col("_y"))).alias(f"_l{k + max_lag}") for k in lags])
    means = shifted.groupBy(*series).agg(*[F.avg(f"_l{k + max_lag}").alias(f"_l{k + max_lag}") for k in lags])
    cells = F.array(*[F.struct(F.lit(k).cast("int").alias("lag"), F.col(f"_l{k + max_lag}").alias("r")) for k in lags])
    return means.select(*series, F.explode(cells).alias("c")).select(*series, "c.*")


def ccf_peak(correlations: DataFrame, series: list[str]) -> DataFrame:
    """The lag of the greatest absolute correlation, the smallest lag on ties."""
    best = F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag")))
    return correlations.groupBy(*series).agg(best.alias("p")).select(*series, F.col("p.lag").alias("peak_lag"), F.col("p.r").alias("peak_r"))


def granger_lag1(rows: DataFrame, cause: str, effect: str, series: list[str], order: str) -> DataFrame:
    """F statistic of Granger's SSR test at lag 1: does the cause's past help to predict the effect?

    Both regressions come from centred sums in one aggregate. With y on (1, y1) the
    residual sum is Syy - Sy1^2/S11; adding x1 takes off the squared partial covariance.
    """
    w = Window.partitionBy(*series).orderBy(order)
    lagged = rows.select(*series, F.col(effect).alias("y"), F.lag(effect).over(w).alias("y1"), F.lag(cause).over(w).alias("x1")).filter("y1 is not null and x1 is not null and y is not null")
    s = lambda a, b: (F.covar_pop(a, b) * F.count(F.lit(1)))
    sums = lagged.groupBy(*series).agg(
        F.count(F.lit(1)).alias("t"), s("y", "y").alias("yy"), s("y", "y1").alias("y1y"), s("y1", "y1").alias("y11"), s("y", "x1").alias("x1y"), s("x1", "x1").alias("x11"), s("y1", "x1").alias("xy1")
    )
    restricted = F.col("yy") - F.col("y1y") * F.col("y1y") / F.col("y11")
    partial = F.col("x1y") - F.col("xy1") * F.col("y1y") / F.col("y11")
    spread = F.col("x11") - F.col("xy1") * F.col("xy1") / F.col("y11")
    gain = partial * partial / spread
    f = gain / ((restricted - gain) / (F.col("t") - 3))
    return sums.select(*series, "t", restricted.alias("ssr_restricted"), (restricted - gain).alias("ssr_full"), f.alias("f_stat"))
