"""Running streams over landed files: days that repair themselves, closed days, limited calls."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pulselake.sources import versioned
from pulselake.streaming.events import closed_days

DAILY = "day date, event_type string, n long, total decimal(38,2)"
#: The daily table's mark of the newest day that any batch has brought.
NEWEST = "newest"


def landed(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def catch_up(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Runs a stream over everything that has landed since its last run, then ends; the checkpoint knows where that was."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def repairing_sink(daily: str, late: str, stream: str, days: int = 15) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds each batch to the daily totals of its days.

    Rows of up to ``days`` days before the newest day that earlier batches have brought repair
    their day: only the folders of the batch's days are written anew. Older rows, and rows
    without a time, go to the ``late`` table as they are. Both tables keep the number of the
    stream's last batch, so a batch that comes again changes nothing. The late table goes
    first: until the daily table has the batch, the newest day is still the one that the
    batch was split by.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", F.to_date("ts"))
        newest = versioned.snapshot(spark, daily).marks.get(NEWEST)
        first = F.lit(date.fromisoformat(newest) - timedelta(days=days) if newest else None).cast("date")
        in_time = F.col("day").isNotNull() & (first.isNull() | (F.col("day") >= first))
        versioned.append(rows.filter(~in_time), late, (stream, number))
        sums = rows.filter(in_time).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        add = lambda stored, new: stored.unionByName(new).groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        last = rows.filter(in_time).agg(F.max("day")).first()[0]
        marks = {NEWEST: max(filter(None, (newest, last and last.isoformat())))} if newest or last else {}
        versioned.rewrite(sums, daily, add, "repair", (stream, number), marks)

    return write


def closing_sink(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds closed days to a versioned table, each batch once."""
    return lambda batch, number: versioned.append(batch, path, (stream, number)) and None


def repair_days(spark: SparkSession, landing: str, schema: StructType | str, daily: str, late: str, checkpoint: str, days: int = 15) -> None:
    """One run of the repairing stream over what has landed."""
    versioned.create(spark, daily, DAILY, "day")
    versioned.create(spark, late, f"{schema}, day date", "day")
    catch_up(landed(spark, landing, schema), checkpoint, repairing_sink(daily, late, "events", days))


def close_days(spark: SparkSession, landing: str, schema: StructType | str, closed: str, checkpoint: str, lateness: str = "15 days") -> None:
    """One run of the stream that gives out a day's totals once the watermark has passed its end."""
    versioned.create(spark, closed, "day date, event_type string, n long, total double", "day")
    catch_up(closed_days(landed(spark, landing, schema), lateness), checkpoint, closing_sink(closed, "closed"))
