"""A stream of the whole lines appended to text files.

Spark's file source takes a file once. Training logs grow, so this source keeps a byte offset per file as the progress of the stream:
a batch is what lies between two sets of offsets. It always ends after a line break, so a line that is still being written
waits for the next batch. Spark records both sets in the checkpoint, and a repeated batch reads the same bytes.
"""

from __future__ import annotations

import fnmatch
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarryline.sources.listing import open_store, shown
from quarryline.sources.logs import RUN_DIR

SPLIT_BYTES = 64 << 20
_LOOK_BACK = 1 << 16
_LINES_PER_BATCH = 10_000
_SCHEMA = "path string, offset bigint, value string"


def whole_lines(files: fs.FileSystem, path: str, size: int) -> int:
    """The place after the last line break of a file, 0 if there is none."""
    with files.open_input_file(path) as stream:
        end = size
        while end > 0:
            start = max(0, end - _LOOK_BACK)
            found = stream.read_at(end - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    start: int
    stop: int


def ranges(before: dict[str, int], after: dict[str, int], split_bytes: int) -> list[_Range]:
    """Byte ranges that came between two sets of offsets. A file shorter than it was has been replaced and starts anew."""
    found = []
    for path, stop in sorted(after.items()):
        first = before.get(path, 0)
        first = first if first <= stop else 0
        found += [_Range(path, first, at, min(at + split_bytes, stop)) for at in range(first, stop, split_bytes)]
    return found


def lines(stream, part: _Range) -> Iterator[tuple[int, bytes]]:
    """Lines that start in a range, each with the place where it starts; the last one may end behind the range.

    A range starts at a line if it is the first of its file's new bytes; the others begin after the first line break that
    the range before them reads to. Carriage returns end lines as well, as progress bars write them.
    """
    at = part.start
    if part.start > part.first:
        stream.seek(part.start - 1)
        at += len(stream.readline()) - 1
    stream.seek(at)
    while at < part.stop:
        line = stream.readline()
        place = at
        at += len(line)
        for piece in re.split(rb"\r(?!\n)", line.removesuffix(b"\n").removesuffix(b"\r")):
            yield place, piece
            place += len(piece) + 1


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, path = open_store(self.path)
        listed = files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return {
            f.path: whole_lines(files, f.path, f.size)
            for f in listed
            if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.pattern) and shown(f.base_name)
        }

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return ranges(start, end, self.split_bytes)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files, _ = open_store(self.path)
        batch: list[tuple[int, bytes]] = []
        with io.BufferedReader(files.open_input_file(partition.path), 1 << 20) as stream:
            for found in lines(stream, partition):
                batch.append(found)
                if len(batch) == _LINES_PER_BATCH:
                    yield self._rows(partition.path, batch)
                    batch = []
        if batch:
            yield self._rows(partition.path, batch)

    @staticmethod
    def _rows(path: str, batch: list[tuple[int, bytes]]) -> pa.RecordBatch:
        text = [line.decode("utf-8", "replace") for _, line in batch]
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(batch)), pa.array([at for at, _ in batch], pa.int64()), pa.array(text, pa.string())], ["path", "offset", "value"]
        )


class TailedText(DataSource):
    """``spark.readStream.format("tailed_text").option("path", folder).option("pattern", "*.log")``"""

    @classmethod
    def name(cls) -> str:
        return "tailed_text"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(dict(self.options))


def tail_text(spark: SparkSession, path: str, pattern: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """New whole lines of the files below a folder as a stream of ``path``, ``offset`` and ``value``."""
    spark.dataSource.register(TailedText)
    return spark.readStream.format("tailed_text").option("path", path).option("pattern", pattern).option("splitBytes", split_bytes).load()


def tail_logs(
    spark: SparkSession, path: str, phases: DataFrame, pattern: str = "output.log", run_dir: str = RUN_DIR, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Appended log lines as ``run, phase_no, block, seq, line``, the columns of a scan of the same logs.

    ``block`` is the file and ``seq`` the line's byte offset in it. Logs of unlisted run folders are left out.
    """
    found = tail_text(spark, path, pattern, split_bytes).select(
        F.regexp_extract("path", run_dir, 1).alias("run_dir"), F.col("path").alias("block"), F.col("offset").alias("seq"), F.col("value").alias("line")
    )
    return found.join(phases.select("run_dir", "run", "phase_no"), "run_dir").select("run", "phase_no", "block", "seq", "line")
