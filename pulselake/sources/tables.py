"""Sources and sinks: raw day folders, JSON lines, whole texts, table replacement."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path that all executors share, deleted when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="pulselake-"))
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def raw_days(spark: SparkSession, folder: str, kind: str, schema: StructType | str) -> DataFrame:
    """JSON files ``folder/YYYY-MM-DD/<kind>*.json`` with a declared schema.

    Absent fields and unreadable files give nulls, not failures; ``folder_day`` is the
    folder's date (null for names that are no dates) and ``activity_id`` the number in an
    activity file's name.
    """
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*/{kind}*.json")
    name = F.input_file_name()
    return rows.withColumn("folder_day", F.expr("try_to_date(regexp_extract(input_file_name(), '([0-9]{4}-[0-9]{2}-[0-9]{2})/[^/]*$', 1), 'yyyy-MM-dd')")).withColumn(
        "activity_id", F.regexp_extract(name, r"activity_(\d+)_", 1).try_cast("bigint")
    )


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped and bad ones kept in ``_corrupt_record``."""
    declared = spark.createDataFrame([], schema).schema.add("_corrupt_record", "string")
    return spark.read.schema(declared).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, sha256): one row per file, stripped."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return rows.select("path", F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"), F.sha2("value", 256).alias("sha256"))


def valid_binaries(spark: SparkSession, path: str, magic: bytes = b"%PDF-", least: int = 1024) -> DataFrame:
    """(path, length, valid): files that begin with ``magic`` and are not too small."""
    files = spark.read.format("binaryFile").load(path)
    good = (F.expr(f"substring(content, 1, {len(magic)})") == F.lit(bytearray(magic))) & (F.col("length") >= least)
    return files.select("path", "length", good.alias("valid"))


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The Parquet table at ``path``, or a typed empty one where there is none."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    return spark.read.parquet(path) if there else spark.createDataFrame([], schema)


def replace(rows: DataFrame, path: str) -> None:
    """Write beside the table, then swap directories, so a reader never sees half a table."""
    spark = rows.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.option("compression", "snappy").parquet(new)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(jvm.Path(path)):
        files.rename(jvm.Path(path), jvm.Path(old))
    files.rename(jvm.Path(new), jvm.Path(path))
    if files.exists(jvm.Path(old)):
        files.delete(jvm.Path(old), True)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def missing_files(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Listed files (path, length) that are not there with the same size."""
    return remote.join(local.select("path", "length"), ["path", "length"], "left_anti")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, by metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length")


def features_or_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The Parquet file of a name without ending, or the CSV beside it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.parquet")
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.read.parquet(f"{path}.parquet")
    return spark.read.schema(schema).option("header", True).csv(f"{path}.csv")


def catalog(spark: SparkSession) -> DataFrame:
    """(name, kind) of the session's tables and views; one row each, from the catalog."""
    rows = [(t.name, "view" if "VIEW" in t.tableType or t.isTemporary else "table") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string")


def purge_days(rows: DataFrame, folder_day: str, as_of) -> DataFrame:
    """Without folders of days at or after ``as_of``; names that are no dates stay."""
    day = F.try_to_date(folder_day, "yyyy-MM-dd")
    return rows.filter(day.isNull() | (day < as_of))
