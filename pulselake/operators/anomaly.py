"""Anomalies of daily metrics: z-score rules, severities, isolation forest, local outlier factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulselake.operators.neighbours import nearest_points
from pulselake.operators.quantiles import exact_quantiles
from pulselake.operators.stats import z_score
from pulselake.operators.vector_index import settled
from pulselake.operators.windows import fill_both


def impute(rows: DataFrame, features: list[str], series: list[str] | None = None, order: str | None = None) -> DataFrame:
    """All rows, with every feature known (as double): filled forward and then backward within the
    series, then by the feature's median, and by 0 where no row has a value."""
    number = {c: F.col(c).cast("double") for c in features}
    filled = rows.withColumns({c: F.when(~F.isnan(v), v) for c, v in number.items()})
    medians = [exact_quantiles(filled, c, [], [0.5]).select(F.get("q", F.lit(0)).alias(f"_m{k}")) for k, c in enumerate(features)]
    if series and order:
        filled = filled.withColumns({c: fill_both(c, series, order) for c in features})
    for m in medians:
        filled = filled.join(F.broadcast(m))
    whole = {c: F.coalesce(c, f"_m{k}", F.lit(0.0)) for k, c in enumerate(features)}
    return filled.withColumns(whole).drop(*[f"_m{k}" for k in range(len(features))])


def rule_factors(rows: DataFrame, rules: list[tuple[str, str, float, str]], series: list[str]) -> DataFrame:
    """Adds ``factors``: the texts of the rules (column, '<' or '>', z, text) that hold."""
    scored = rows
    for k, (column, _, _, _) in enumerate(rules):
        scored = scored.withColumn(f"_z{k}", z_score(column, series))
    hits = [F.when(F.col(f"_z{k}") < z if sign == "<" else F.col(f"_z{k}") > z, F.lit(text)) for k, (_, sign, z, text) in enumerate(rules)]
    return scored.withColumn("factors", F.array_compact(F.array(*hits))).drop(*[f"_z{k}" for k in range(len(rules))])


def factor_texts(rows: DataFrame, series: list[str]) -> DataFrame:
    """Adds ``factors``: the texts, with value and z-score, of the five physiological rules that hold.

    Columns hrv_rmssd, resting_heart_rate, daily_avg_stress, sleep_score and total_steps; z-scores are
    within the series; a null value has no factor.
    """
    names = ["hrv_rmssd", "resting_heart_rate", "daily_avg_stress", "sleep_score", "total_steps"]
    scored = rows.withColumns({f"_{n}": F.col(n).cast("double") for n in names})
    for n in names:
        scored = scored.withColumn(f"_z_{n}", z_score(f"_{n}", series))
    z = {n: F.col(f"_z_{n}") for n in names}
    z_text = lambda n: z[n].cast("decimal(9,1)").cast("string")
    shown = lambda n, digits: F.col(n).cast(f"decimal(18,{digits})").cast("string")
    hits = [
        F.when(z["hrv_rmssd"] < -1.5, F.concat(F.lit("HRV significantly suppressed ("), shown("hrv_rmssd", 1), F.lit(" ms, Z="), z_text("hrv_rmssd"), F.lit(")"))),
        F.when(z["resting_heart_rate"] > 1.5, F.concat(F.lit("Elevated Resting HR ("), shown("resting_heart_rate", 0), F.lit(" bpm, Z=+"), z_text("resting_heart_rate"), F.lit(")"))),
        F.when(z["daily_avg_stress"] > 1.5, F.concat(F.lit("High autonomic stress score ("), shown("daily_avg_stress", 0), F.lit(", Z=+"), z_text("daily_avg_stress"), F.lit(")"))),
        F.when(z["sleep_score"] < -1.5, F.concat(F.lit("Poor sleep restoration score ("), shown("sleep_score", 0), F.lit(", Z="), z_text("sleep_score"), F.lit(")"))),
        F.when(
            F.abs(z["total_steps"]) > 2,
            F.concat(F.lit("Extreme activity "), F.when(z["total_steps"] > 0, "Spike").otherwise("Drop"), F.lit(" ("), shown("total_steps", 0), F.lit(" steps, Z="), F.when(z["total_steps"] > 0, "+").otherwise(""), z_text("total_steps"), F.lit(")")),
        ),
    ]
    return scored.withColumn("factors", F.array_compact(F.array(*hits))).drop(*[p + n for n in names for p in ("_", "_z_")])


def severity(factors: Column, detectors: Column) -> Column:
    """Both detectors or two factors: acute; one of either: mild; else normal."""
    return F.when((detectors >= 2) | (factors >= 2), "ACUTE_ALERT").when((detectors >= 1) | (factors >= 1), "MILD_ANOMALY").otherwise("NORMAL")


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_forest(sample: np.ndarray, trees: int = 100, size: int = 256, seed: int = 42) -> list[list[tuple]]:
    """Isolation trees as node lists (feature, split, left, right, points)."""
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = sample[rng.choice(len(sample), min(size, len(sample)), replace=False)]
        limit, nodes = int(np.ceil(np.log2(max(2, len(rows))))), []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, -1, -1, len(part)))
            spread = part.max(axis=0) > part.min(axis=0) if len(part) else np.zeros(sample.shape[1], bool)
            if depth < limit and len(part) > 1 and spread.any():
                f = int(rng.choice(np.flatnonzero(spread)))
                split = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                left = grow(part[part[:, f] < split], depth + 1)
                right = grow(part[part[:, f] >= split], depth + 1)
                nodes[at] = (f, split, left, right, len(part))
            return at

        grow(rows, 0)
        forest.append(nodes)
    return forest


def forest_scores(forest: list[list[tuple]], x: np.ndarray, size: int = 256) -> np.ndarray:
    """Anomaly scores in (0, 1); higher is odder."""
    total = np.zeros(len(x))
    for nodes in forest:
        feature, split, left, right, points = (np.array(c) for c in zip(*nodes))
        at, depth = np.zeros(len(x), int), np.zeros(len(x))
        while (inner := feature[at] >= 0).any():
            down = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] < split[at], left[at], right[at])
            at, depth = np.where(inner, down, at), depth + inner
        total += depth + _path_length(points[at])
    return 2 ** -(total / len(forest) / max(1e-9, float(_path_length(np.array(min(size, nodes[0][4]))))))


def isolation_forest(rows: DataFrame, features: list[str], contamination: float = 0.15, sample_rows: int = 10_000, seed: int = 42) -> DataFrame:
    """Adds ``iforest_score`` and ``iforest_flag``: the ``contamination`` share of greatest scores.

    Trees grow on a bounded hash sample; every row is scored in Arrow batches. Missing
    features take the feature's median; ``impute`` fills within series before.
    """
    complete = impute(rows, features)
    share = min(1.0, sample_rows / max(1, complete.count()))
    drawn = complete.filter(F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = drawn.select(*[F.col(c).cast("double") for c in features]).orderBy(*features).limit(sample_rows).toPandas().to_numpy()
    forest = rows.sparkSession.sparkContext.broadcast(grow_forest(sample, seed=seed) if len(sample) else [])

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(forest_scores(forest.value, x))

    scored = complete.withColumn("iforest_score", score(*[F.col(c).cast("double") for c in features]))
    cut = exact_quantiles(scored, "iforest_score", [], [1 - contamination]).select(F.get("q", F.lit(0)).alias("cut"))
    return scored.join(F.broadcast(cut)).withColumn("iforest_flag", F.col("iforest_score") > F.col("cut")).drop("cut")


def local_outlier_factor(rows: DataFrame, key: str, features: list[str], series: list[str], k: int = 5, contamination: float = 0.15) -> DataFrame:
    """(series, key, lof, lof_flag) with each row scored as a new point, so it is its own nearest neighbour.

    Every row is scored, missing features are imputed. A row is flagged if its factor is
    above the (1 - ``contamination``) quantile of the factors that the series' rows have as
    neighbours of each other; the only row of a series has factor 1 and no flag. Neighbours
    are sought within a series only (``neighbours``: cells with bounds, so a series is never
    held whole); densities come to a point by joins on its ``k`` neighbours.
    """
    kept = impute(rows, features, series, key).select(*series, key, *features)
    # ids in order of the key, which decides between equal distances
    numbered = kept.repartitionByRange(*series, key).sortWithinPartitions(*series, key).withColumn("_id", F.monotonically_increasing_id())
    named = settled(numbered, "rows")
    groups = settled(named.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_g")).withColumnsRenamed({c: f"_of_{c}" for c in series}), "groups")
    named = named.join(groups, [named[c].eqNullSafe(groups[f"_of_{c}"]) for c in series]).drop(*[f"_of_{c}" for c in series])
    points = named.select(F.col("_id").alias("id"), F.col("_g").alias("g"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    near = settled(nearest_points(points, k, len(features)), "near")

    reach = settled(near.groupBy("id").agg(F.max("distance").alias("k_distance")), "reach")
    of_near = reach.select(F.col("id").alias("near"), "k_distance")
    edges = near.select("id", "near", "distance").join(of_near, "near")
    dense = 1 / (F.avg(F.greatest("k_distance", "distance")) + 1e-10)
    density = settled(edges.groupBy("id").agg(dense.alias("density")), "density")
    of_density = density.select(F.col("id").alias("near"), F.col("density").alias("near_density"))
    met = edges.join(of_density, "near")
    itself = reach.join(density, "id").select(F.col("id").alias("near"), "id", F.lit(0.0).alias("distance"), "k_distance", F.col("density").alias("near_density"))
    # the point itself is among its neighbours, in place of the last of them
    count = near.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("id").orderBy("distance", "near")
    own = met.unionByName(itself).withColumn("_place", F.row_number().over(order)).join(count, "id").filter(F.col("_place") <= F.col("size"))
    lof = own.groupBy("id").agg((F.avg("near_density") * (F.avg(F.greatest("k_distance", "distance")) + 1e-10)).alias("lof"))
    mutual = met.join(density, "id").groupBy("id").agg(F.avg(F.col("near_density") / F.col("density")).alias("mutual"))
    names = named.select(F.col("_id").alias("id"), F.col("_g").alias("g"), *series, key)
    scored = settled(names.join(lof, "id", "left").join(mutual, "id", "left"), "scored")
    cuts = exact_quantiles(scored, "mutual", ["g"], [1 - contamination]).select("g", F.get("q", F.lit(0)).alias("cut"))
    flagged = scored.join(cuts, "g", "left")
    return flagged.select(*series, key, F.coalesce("lof", F.lit(1.0)).alias("lof"), F.coalesce(F.col("lof") > F.col("cut"), F.lit(False)).alias("lof_flag"))


def severities(rows: DataFrame, key: str, rules: list[tuple[str, str, float, str]], series: list[str]) -> DataFrame:
    """(series, key, iforest_flag, lof_flag, factors, severity) of every row from both detectors and the rules.

    ``rows`` have no missing features and one row a (series, key).
    """
    features = list(dict.fromkeys(r[0] for r in rules))
    forest = rule_factors(isolation_forest(rows, features), rules, series).select(*series, key, "iforest_flag", "factors")
    outliers = local_outlier_factor(rows, key, features, series).drop("lof")
    same = [forest[c].eqNullSafe(outliers[c]) for c in [*series, key]]
    found = forest.join(outliers, same).select(*[forest[c] for c in [*series, key]], "iforest_flag", "lof_flag", "factors")
    detectors = F.col("iforest_flag").cast("int") + F.col("lof_flag").cast("int")
    return found.withColumn("severity", severity(F.size("factors"), detectors))


#: Words in factor texts that point to a metric (fixed values).
FACTOR_WORDS = {
    "daily_avg_stress": ["stress"],
    "resting_heart_rate": ["resting hr", "heart rate"],
    "running_avg_hr": ["running", "heart rate"],
    "gym_avg_hr": ["gym", "heart rate"],
    "walking_avg_hr": ["walking", "heart rate"],
    "hrv_rmssd": ["hrv", "rmssd"],
    "sleep_score": ["sleep"],
    "total_sleep_hours": ["sleep"],
    "total_steps": ["step", "activity"],
    "active_kilocalories": ["calorie", "cals", "activity"],
    "total_kilocalories": ["calorie", "cals"],
    "resting_kilocalories": ["calorie", "resting"],
}


def affects(factors: Column, target: str) -> Column:
    """Whether one of the factor texts points to the target metric."""
    words = FACTOR_WORDS.get(target, [target.replace("_", " ")])
    return F.exists(factors, lambda f: F.lower(f).rlike("|".join(words)))
