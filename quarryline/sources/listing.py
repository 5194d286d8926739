"""Listings of large stores as tables that executors make.

Spark's own readers keep the status of every file on the driver. A listing of millions of objects needs no more there than its
first-level prefixes: each is a partition of this source, and the task that reads it walks what lies below.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_ROWS_PER_BATCH = 10_000


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path: local, or one that Arrow knows by its scheme."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def shown(name: str) -> bool:
    """Files that Spark's readers would see: none that start with a dot or an underscore."""
    return not name.startswith((".", "_"))


@dataclass
class _Prefix(InputPartition):
    folder: str
    recursive: bool


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")

    def partitions(self) -> list[_Prefix]:
        store, root = open_store(self.path)
        below = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and shown(f.base_name)]
        return [_Prefix(root, False), *(_Prefix(folder, True) for folder in sorted(below))]

    def read(self, partition: _Prefix) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        folders, rows = [partition.folder], []
        while folders:
            for f in store.get_file_info(fs.FileSelector(folders.pop())):
                if f.type == fs.FileType.Directory:
                    folders += [f.path] if partition.recursive and shown(f.base_name) else []
                elif shown(f.base_name) and fnmatch.fnmatchcase(f.base_name, self.pattern):
                    rows.append((f.path, f.base_name, f.size))
                if len(rows) == _ROWS_PER_BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, names, sizes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(names), pa.array(sizes, pa.int64())], ["path", "name", "length"])


class FileListing(DataSource):
    """``spark.read.format("file_listing").option("path", folder).option("pattern", "*.parquet")``"""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, name string, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``name`` and ``length`` of the files below a folder, walked by one task per first-level folder.

    Names that start with a dot or an underscore are left out, as Spark's readers do. The store is one that Arrow opens;
    :func:`quarryline.sources.files.file_manifest` lists any that Spark reads.
    """
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("path", path).option("pattern", pattern).load()


def with_prefix(listing: DataFrame, root: str, prefix: str) -> DataFrame:
    """The files whose path below the root starts with a prefix."""
    _, folder = open_store(root)
    return listing.filter(F.col("path").startswith(f"{folder.rstrip('/')}/{prefix}"))
