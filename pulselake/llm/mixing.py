"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulselake.llm.common import materialise

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def fair_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> dict[str | None, float]:
    """Target of every source: weights repeat over the sources in code-point order, null last.

    A target stops at ``limit`` times its source's size; what is over is shared again by
    weight among the others until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > limit * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return {s: max(0.0, t) for s, t in target.items()}


#: Rows of a source that one task sums up, about.
RANGE_ROWS = 1 << 17


def _queue(docs: DataFrame, weights: tuple[float, ...], share: float, limit: int, seed: int, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, copies) of the mix; copies: _row, copy, at, words, in (_part, at, ...) order."""
    spark = docs.sparkSession
    base = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.length("text")), 1).alias("_h"),
            F.xxhash64("text").alias("_tie"),
            *[F.col(c) for c in keep],
        ).withColumn("_source", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")))
    )
    bits = min(24, max(1, (base.count() // RANGE_ROWS).bit_length()))
    queued = base.select("_row", "_source", "size", "_h", "doc_id", "_tie", F.shiftright("_h", 63 - bits).cast("int").alias("_range"))
    ranges = materialise(queued.groupBy("_source", "_range").agg(F.sum("size").alias("_n")))
    sizes = {r["_source"]: r["n"] for r in ranges.groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
    named = {None if s == "n" else s[1:]: n for s, n in sizes.items()}
    targets = fair_targets(named, weights, share, limit)
    sources = spark.createDataFrame([("n" if s is None else "s" + s, named[s], float(targets[s])) for s in named], "_source string, source_size long, target double")

    upto = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n").join(sources, "_source")
    inside = Window.partitionBy("_source", "_range").orderBy("_h", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = queued.filter("size > 0").withColumn("_end", F.sum("size").over(inside)).join(offsets, ["_source", "_range"]).filter("target > 0")
    copies = ended.select("_row", "size", "target", "_h", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda p: F.col("_offset") + F.col("_end") + F.col("source_size") * p)).alias("copy", "end"))
    # the mix ends at virtual time 1; what a source has in service then is cut there
    words = F.least(F.col("size"), F.round("target").cast("long") - F.col("end") + F.col("size"))
    copies = copies.select("_row", "copy", "_h", F.least(F.lit(1.0), F.col("end") / F.col("target")).alias("at"), words.alias("words")).filter("words > 0")
    order = ["at", "_h", "_row", "copy"]
    ordered = materialise(copies.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))

    # truncate the global order at the whole budget
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    parts = ordered.groupBy("_part").agg(F.sum("words").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_spent"))
    running = F.col("_spent") + F.sum("words").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    budget = F.lit(round(sum(targets.values()))).cast("long")
    left = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), budget - F.col("_upto") + F.col("words")))
    cut = ordered.join(parts, "_part").withColumn("_upto", running).withColumn("words", left).filter("words > 0")
    return base, sources, cut.select("_row", "copy", "at", "_h", "words")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: int = 2, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Take documents (up to ``limit`` times each) so that sources meet their targets.

    Within a source, documents stand in a hash order of (doc_id, text length). The p-th
    copy of a document begins when (words before it + (p-1) * source words) / target of
    virtual time has passed and finishes its own words / target later. All copies of all
    sources are range-sorted by virtual finish time, and the mix is truncated where the
    total budget (the sum of the targets) is spent. Every source is served in proportion to
    its target, so that is at virtual time 1: copies that have finished are taken whole, the
    one in service in each source is cut there.

    Adds ``size`` (words), ``source_size``, ``target`` and ``taken`` (words, repeats counted)
    to (doc_id, source) and the columns named in ``keep``. Running sums are kept per (source,
    hash range) with about ``RANGE_ROWS`` rows a range, so a source of any share of the rows is
    spread over many tasks; the driver sees one row per source only.

    Null text or text without words has size 0 and is never taken; null source is a source
    of its own; repeated rows are documents of their own; very long texts are cut like others;
    empty input gives an empty result; other columns are ignored, whatever their names.
    """
    base, sources, copies = _queue(docs, weights, share, limit, seed, keep)
    taken = copies.groupBy("_row").agg(F.sum("words").alias("taken"))
    found = base.join(taken, "_row", "left").join(sources, "_source")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), *keep)


def mixed_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: int = 2, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per copy that the mix takes (see ``mix``), range-sorted by virtual finish time over all sources.

    (doc_id, source, size, copy, at, words, ...): ``copy`` counts from 0 and ``words`` is what
    is taken of it; the last copy of a source may be cut, with fewer words than ``size``.
    """
    base, _, copies = _queue(docs, weights, share, limit, seed, keep)
    found = copies.drop("_h").join(base, "_row").repartitionByRange("at", "_h", "_row", "copy").sortWithinPartitions("at", "_h", "_row", "copy")
    return found.select("doc_id", "source", "size", "copy", "at", "words", *keep)
