"""Multiple-choice benchmark files: CSV, JSON lists or wrapped lists, JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.text import decoded_path
from quarryline.operators.order import blocked_index
from quarryline.session import new_folder
from quarryline.sources.corpus import union_by_name
from quarryline.sources.json_lists import json_list_records


def _file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def _numbered(df: DataFrame) -> DataFrame:
    """Add ``source_row``, the row's place in its file, counted split by split."""
    return blocked_index(df, ["_file"], ["_block"], ["_seq"], "source_row").drop("_file", "_block", "_seq")


def _with_position(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        _file_stem().alias("file_stem"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A headed CSV with every column a string; quoted fields may hold quotes and line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def mcq_scan(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Benchmark rows with ``file_stem`` and ``source_row`` beside the file's own columns.

    Blank CSV cells are empty strings, as they are present but blank. JSON may be a list of rows or
    an object with the list under ``examples`` or ``data``; a large file is read by several tasks.
    """
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        return _numbered(_with_position(read_csv(spark, path))).na.fill("")
    if fmt in ("jsonl", "ndjson"):
        reader = spark.read.schema(schema) if schema else spark.read
        return _numbered(_with_position(reader.json(path)))
    if fmt == "json":
        return _json_rows(spark, path, schema)
    raise ValueError(f"unsupported benchmark format: {path}")


def _json_rows(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """The rows of JSON lists, by way of JSON lines, which Spark types and splits as usual."""
    stem = F.regexp_extract(decoded_path("_file"), r"([^/]*?)(\.[^./]*)?$", 1)
    named = F.to_json(F.struct(stem.alias("file_stem"), "source_row"))
    lines = F.concat(F.regexp_replace(named, r"\}$", ""), F.lit(', "row": '), F.col("record"), F.lit("}"))
    folder = new_folder(spark, "json-lines")
    json_list_records(spark, path).select(lines.alias("value")).write.text(folder)
    rows = schema and T.StructType().add("file_stem", "string").add("source_row", "bigint").add("row", schema)
    found = (spark.read.schema(rows) if rows else spark.read).json(folder)
    if "row" not in found.columns:
        raise ValueError(f"no rows in the JSON lists of {path}")
    return found.select("row.*", "file_stem", "source_row")


def _unglobbed(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def combine_category_files(spark: SparkSession, base: str, split: str, pattern: str = "CDPK_*_{split}.csv") -> DataFrame:
    """All category files of a split as one table, columns matched by name, with their ``category_file``.

    Files are read as named below ``base/split``; those with one header line are read together. Files without any line are left out.
    """
    glob = f"{base}/{split}/{pattern.format(split=split)}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(glob)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    paths = sorted(status.getPath().toString() for status in (found or []))
    if not paths:
        raise FileNotFoundError(f"no category files match {glob}")
    line = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    lines = spark.read.text([_unglobbed(p) for p in paths]).select(decoded_path().alias("path"), "value", line.alias("line"))
    heads = lines.groupBy("path").agg(F.min_by("value", "line").alias("header"))
    same = heads.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.col("paths")[0])
    frames = [read_csv(spark, [_unglobbed(p) for p in row["paths"]]).select("*", decoded_path().alias("_path")) for row in same.collect()]
    name = F.regexp_extract("_path", rf"([^/=]*_{split}\.csv)", 1)
    return union_by_name(frames).withColumn("category_file", name).withColumn("split", F.lit(split)).drop("_path")


def combine_report(combined: DataFrame) -> DataFrame:
    """Files and rows per split."""
    per_file = combined.groupBy("split", "category_file").agg(F.count("*").alias("n"))
    return per_file.groupBy("split").agg(F.count("*").alias("files"), F.sum("n").alias("rows"))
