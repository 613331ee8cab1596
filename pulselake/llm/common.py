"""Helpers shared by the corpus operators: shared storage, ranks and running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); in local mode, where that is unset, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pulselake-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so lost executors cost nothing upstream."""
    spark = df.sparkSession
    path = new_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, text: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, some ``size`` bytes of the column ``text`` at a time; a document is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = (np.cumsum(sizes) - sizes) // size
    edges = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), batch.num_rows]
    for at, end in zip(edges, edges[1:]):
        yield batch.slice(at, end - at)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int | Column = 64) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... without gaps inside each group, in no particular order.

    A group is split into ``buckets`` hash buckets (a number, or a column that is constant
    within a group); a bucket's first number is the size of the buckets before it, so no task
    ever holds a whole group. ``df`` is read twice, so it should be a materialised table.
    Repeated rows get different numbers.
    """
    count = buckets if isinstance(buckets, Column) else F.lit(buckets)
    parted = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), count).cast("int"))
    sizes = parted.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = parted.withColumn("_inside", F.row_number().over(inside))
    return numbered.join(offsets, [*group, "_bucket"]).withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_before", "_inside")
