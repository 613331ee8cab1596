"""A Spark data source of raw day folders: one partition a day, filters on the day pushed down, and a stream of new days.

``root/YYYY-MM-DD/<kind>.json`` and ``root/YYYY-MM-DD/activities/activity_<id>_summary.json`` with
``activity_<id>.zip`` beside it, if that was stored. Each JSON file is a row; one that cannot be
read or is no JSON is a row with its ``error``. The source's readers are Python processes
without Spark's own file systems, so a root has to be in a store that pyarrow opens (local and
mounted folders, ``hdfs``, ``s3``, ``gs``, ``abfs``); ``tables.raw_days`` reads any other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

NAME = "dayfolders"
SCHEMA = "day date, folder string, kind string, activity_id bigint, payload string, package string, path string, error string"
SKIPPED = {"sample", ".git"}
_ACTIVITY = re.compile(r"activity_([^_]+)_summary\.json")


def _files(root: str):
    from pyarrow import fs

    scheme, rest = root.split("://", 1) if "://" in root else ("file", root)
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{rest}")


def _listed(files, folder: str) -> list:
    from pyarrow import fs

    return sorted(files.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.base_name)


def day_of(folder: str) -> date | None:
    """The day that a folder is named after, or None."""
    try:
        return date.fromisoformat(folder) if re.fullmatch(r"\d{4}-\d\d-\d\d", folder) else None
    except ValueError:
        return None


def folders(root: str) -> list[str]:
    """Names of the day folders, in order."""
    from pyarrow import fs

    files, path = _files(root)
    return [f.base_name for f in _listed(files, path) if f.type == fs.FileType.Directory and f.base_name not in SKIPPED]


@dataclass
class Folder(InputPartition):
    name: str


def rows_of(root: str, folder: str) -> Iterator[tuple]:
    """The rows of one day's files, file by file."""
    from pyarrow import fs

    files, path = _files(root)
    day = day_of(folder)
    plain = [(f, f.base_name[: -len(".json")], None, None) for f in _listed(files, f"{path}/{folder}") if f.type == fs.FileType.File and f.base_name.endswith(".json")]
    inside = _listed(files, f"{path}/{folder}/activities")
    there = {f.base_name: f.path for f in inside}
    found = [(f, m[1]) for f in inside if (m := _ACTIVITY.fullmatch(f.base_name))]
    activities = [(f, "activity", int(i) if i.isdigit() and int(i) < 1 << 63 else None, there.get(f"activity_{i}.zip")) for f, i in found]
    for file, kind, activity, package in plain + activities:
        payload = error = None
        try:
            with files.open_input_stream(file.path) as stream:
                payload = stream.read().decode()
            json.loads(payload)
        except (OSError, ValueError) as wrong:
            error = f"{type(wrong).__name__}: {wrong}"[:200]
        yield day, folder, kind, activity, payload, package, file.path, error


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class DayReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.tests = root, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes the conditions on the day, which choose folders before any is opened, and leaves the others to Spark."""
        for one in filters:
            if getattr(one, "attribute", None) == ("day",) and (type(one) in _TESTS or isinstance(one, IsNotNull)):
                self.tests.append((type(one).__name__, getattr(one, "value", None)))
            else:
                yield one

    def holds(self, folder: str) -> bool:
        day, tests = day_of(folder), {k.__name__: f for k, f in _TESTS.items()}
        return all(day is not None and (name == "IsNotNull" or tests[name](day, value)) for name, value in self.tests)

    def partitions(self) -> list[Folder]:
        return [Folder(f) for f in folders(self.root) if self.holds(f)]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        return rows_of(self.root, partition.name) if partition else iter(())  # None: there is no folder


class DayStream(DataSourceStreamReader):
    """New days in order of their names; the last name that was read is the offset."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"last": max([f for f in folders(self.root) if day_of(f)], default="")}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f) for f in folders(self.root) if day_of(f) and start["last"] < f <= end["last"]]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        return rows_of(self.root, partition.name) if partition else iter(())  # None: there is no folder

    def commit(self, end: dict) -> None:
        pass


class DayFolders(DataSource):
    """``spark.read.format("dayfolders").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DayReader:
        return DayReader(self.options["path"])

    def streamReader(self, schema) -> DayStream:  # noqa: N802
        return DayStream(self.options["path"])


def day_folders(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the folders below ``root``; conditions on ``day`` choose the folders that are opened."""
    _register(spark)
    return spark.read.format(NAME).load(root)


def new_days(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the folders' rows, day by day as they come; a day whose files came later is read again by ``day_folders``."""
    _register(spark)
    return spark.readStream.format(NAME).load(root)


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DayFolders)


def store_files(rows: DataFrame, root: str) -> None:
    """Writes (path, content) as files below ``root``, from the tasks that hold the rows; a retried task writes them again."""

    def write(some: Iterator) -> None:
        files, base = _files(root)
        for row in some:
            target = f"{base}/{row.path}"
            files.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(target) as out:
                out.write(bytes(row.content))

    rows.select("path", "content").foreachPartition(write)
