"""A Python data source that lists files, hidden and empty ones too, and the reasons to skip a file.

`spark.read.format("file_listing").load(path)` after register(spark). Spark's binaryFile reader hides names that start with
a dot or underscore and empty files; reports of skipped files need them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, suffix string, size bigint, depth int, mtime timestamp"
STUBS = [".gdoc", ".gsheet", ".gslides", ".gdraw", ".gform"]


class _Listing(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        self.depth = int(options.get("maxdepth", 64))

    def partitions(self):
        tops = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [InputPartition((self.root, False)), *[InputPartition((t, True)) for t in tops]]

    def read(self, partition):
        import datetime

        top, deep = partition.value
        for folder, names, files in os.walk(top):
            depth = len(os.path.relpath(folder, self.root).split(os.sep)) if folder != self.root else 0
            if not deep or depth >= self.depth:
                names.clear()
            for name in sorted(files):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:
                    yield path, name, os.path.splitext(name)[1].lower(), None, depth, None
                    continue
                yield path, name, os.path.splitext(name)[1].lower(), stat.st_size, depth, datetime.datetime.fromtimestamp(stat.st_mtime)


class FileListing(DataSource):
    @classmethod
    def name(cls):
        return "file_listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Listing(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileListing)


def skip_reason(name: Column, suffix: Column, size: Column) -> Column:
    """The first reason that holds, else null."""
    return (
        F.when(name.startswith("~$"), "lock_file")
        .when(name.startswith("._"), "mac_metadata")
        .when(name.startswith("."), "hidden")
        .when(suffix.isin(*STUBS), "google_stub")
        .when(size == 0, "empty_or_cloud_placeholder")
        .when(size.isNull(), "unreadable")
    )


def scan(files: DataFrame, supported: list[str]) -> DataFrame:
    """Every file with its skip reason; files of other types are `unsupported`."""
    reason = F.coalesce(skip_reason(F.col("name"), F.col("suffix"), F.col("size")), F.when(~F.col("suffix").isin(*supported), "unsupported"))
    return files.withColumn("reason", reason)
