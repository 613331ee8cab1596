"""Exact quantiles of large groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def exact_quantiles(rows: DataFrame, value: str, by: list[str], probabilities: list[float]) -> DataFrame:
    """(by, q): linearly interpolated quantiles of each group, in the order of ``probabilities``.

    ``percentile`` keeps all distinct values of a group in one task's memory. Here values
    are counted first (combined on the map side), then counted per slice of the value
    range; only the slices that hold a wanted rank are ranked, each in a window of its own.
    Slices follow distance from the overall mean on a logarithmic scale, so outliers do not
    use them up. Groups without values are absent.
    """
    v = F.col(value).cast("double")
    known = rows.filter(F.col(value).isNotNull()).select(*by, v.alias("_v"))
    scale = known.agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    counted = known.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(scale))
    away = (F.col("_v") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0) * 1000
    counted = counted.withColumn("_slice", F.floor(F.signum(away) * F.log2(F.abs(away) + 1) * 256)).drop("_m", "_s")

    slices = counted.groupBy(*by, "_slice").agg(F.sum("_n").alias("_k"))
    upto = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_k").over(upto), F.lit(0))).withColumn("_total", F.sum("_k").over(Window.partitionBy(*by)))
    ranks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        ranks += [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), (at - F.floor(at)).alias("part")) for side, rank in ((0, F.floor(at)), (1, F.ceil(at)))]
    wanted = slices.withColumn("_r", F.explode(F.array(*ranks))).filter((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_k")))
    wanted = wanted.select(*by, "_slice", "_before", "_r")

    inside = Window.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = wanted.select(*by, "_slice").distinct()
    chosen = counted.join(keys, [counted[c].eqNullSafe(keys[c]) for c in [*by, "_slice"]], "left_semi").withColumn("_end", F.sum("_n").over(inside))
    same = [chosen[c].eqNullSafe(wanted[c]) for c in [*by, "_slice"]]
    found = chosen.join(wanted, same).select(*[chosen[c] for c in by], "_v", (F.col("_r.rank") - F.col("_before")).alias("_at"), "_end", "_n", "_r")
    found = found.filter((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_n")))
    of = lambda side: F.max(F.when(F.col("_r.side") == side, F.col("_v")))
    each = found.groupBy(*by, F.col("_r.i").alias("_i")).agg(of(0).alias("_lo"), of(1).alias("_hi"), F.max("_r.part").alias("_part"))
    cell = F.struct("_i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("q"))
    ordered = each.groupBy(*by).agg(F.sort_array(F.collect_list(cell)).alias("_q"))
    return ordered.select(*by, F.transform("_q", lambda c: c["q"]).alias("q"))


def with_quantiles(groups: DataFrame, rows: DataFrame, value: str, by: list[str], probabilities: list[float]) -> DataFrame:
    """``groups`` with the column ``q`` of their rows' quantiles; a null key is a group like others, and q is null where there are no values."""
    found = exact_quantiles(rows, value, by, probabilities).withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = [groups[c].eqNullSafe(found[f"_of_{c}"]) for c in by]
    return groups.join(found, same, "left").drop(*[f"_of_{c}" for c in by])
