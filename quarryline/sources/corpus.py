"""Reading corpora: one prefix, drifting schemas, several configs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.text import decoded_path
from quarryline.operators.lookup import fits_broadcast, lookup
from quarryline.operators.order import rows_at, split
from quarryline.session import stage
from quarryline.sources.files import file_manifest

DROP_COLUMNS = ("embedding",)


def _below(path: str, prefix: str) -> str:
    """A glob for what lies below a path and starts with a prefix."""
    return f"{path.rstrip('/')}/{re.sub(r'([\[\]{}*?\\])', r'\\\1', prefix)}*" if prefix else path


def scan_corpus(
    spark: SparkSession, path: str, prefix: str = "", num_files: int = -1, merge_schema: bool = True
) -> DataFrame:
    """All Parquet files whose path below ``path`` starts with ``prefix``, optionally the first N by name.

    The first N are those up to the N-th name: one bound on the file's path, by which Spark leaves the other files out before it
    reads them. No list of names is made, here or in the plan. The columns are those of all files with the prefix.
    """
    where = _below(path, prefix)
    try:
        rows = spark.read.option("mergeSchema", merge_schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(where)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(f"no Parquet files below {path} start with {prefix!r}") from error
    if num_files <= 0:
        return rows
    last = _last_name(file_manifest(spark, where, "*.parquet"), num_files)
    return rows if last is None else rows.filter(decoded_path() <= F.lit(last))


def _last_name(listing: DataFrame, num_files: int) -> str | None:
    """The path of the N-th file by name, or None if there are no more than N."""
    paths = listing.select("path")
    cut = split(paths, ["path"])
    return None if num_files >= cut.total_rows else rows_at(paths, ["path"], [num_files - 1], cut).first()["path"]


def input_files(spark: SparkSession, path: str, prefix: str = "", num_files: int = -1) -> DataFrame:
    """``path`` and ``length`` of the files that :func:`scan_corpus` reads."""
    listing = file_manifest(spark, _below(path, prefix), "*.parquet").select("path", "length")
    last = _last_name(listing, num_files) if num_files > 0 else None
    return listing if last is None else listing.filter(F.col("path") <= F.lit(last))


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The Parquet files of a short list of paths, named as a listing has them."""
    return spark.read.option("mergeSchema", True).parquet(*(re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths))


def dataset_configs(spark: SparkSession, path: str) -> dict[str, str]:
    """The configs of a dataset folder: its sub-folders in name order, or the folder itself if it has none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(folder) if s.isDirectory())
    return {name: where for name, where in found if not name.startswith((".", "_"))} or {folder.getName(): path}


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union whose missing columns become null; numeric columns widen to the wider type."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def union_by_name_scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Read shards whose columns differ; each path keeps its own types until the union."""
    return union_by_name([spark.read.option("mergeSchema", True).parquet(path) for path in paths])


def _file_starts(spark: SparkSession, configs: dict[str, str]) -> DataFrame:
    """Rows of a config before each of its files, by the files' names. Counting without columns reads footers only."""
    counts = [
        spark.read.parquet(path).groupBy(F.lit(config).alias("config"), F.col("_metadata.file_path").alias("_path")).agg(F.count("*").alias("_n"))
        for config, path in configs.items()
    ]
    earlier = Window.partitionBy("config").orderBy(F.url_decode(F.replace("_path", F.lit("+"), F.lit("%2B")))).rowsBetween(Window.unboundedPreceding, -1)
    return union_by_name(counts).select("config", "_path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))


def multi_config_scan(
    spark: SparkSession, configs: dict[str, str], text_columns: dict[str, str] | None = None
) -> DataFrame:
    """Read the configs of a dataset with ``config``, ``source_file`` and ``source_row`` columns.

    ``source_row`` is the row's place in its config, through all its files in the order of their names.
    """
    frames = []
    for config, path in configs.items():
        frame = spark.read.parquet(path).select(
            F.lit(config).alias("config"),
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.row_index").alias("_row"),
            "*",
        )
        if text_columns:
            frame = frame.withColumnRenamed(text_columns[config], "text")
        frames.append(frame)
    starts = stage(_file_starts(spark, configs), "file-starts")
    if fits_broadcast(starts, ["config", "_path"]):
        starts = F.broadcast(starts)
    rows = lookup(union_by_name(frames), starts, ["config", "_path"])
    placed = rows.withColumn("source_row", F.col("_start") + F.col("_row"))
    first = ["config", "source_file", "source_row"]
    return placed.select(*first, *(c for c in placed.columns if c not in (*first, "_path", "_row", "_start")))


# Bytes of one value of the plain types.
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8}


def _width(name: str, dtype: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(dtype, T.ArrayType):
        size = F.size(column) * _WIDTHS.get(dtype.elementType.simpleString(), 8)
    else:
        size = F.lit(_WIDTHS.get(dtype.simpleString(), 8))
    return F.when(column.isNotNull(), size).otherwise(0).cast("bigint")


def row_width(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Uncompressed bytes of a row's values, of all columns or some; nulls have none."""
    return sum((_width(f.name, f.dataType) for f in df.schema if columns is None or f.name in columns), F.lit(0).cast("bigint"))


def widths_saved(widths: DataFrame, kept: str, dropped: str) -> DataFrame:
    """Bytes kept and dropped over all rows, and the percentage dropped, in one row."""
    counted = widths.agg(F.coalesce(F.sum(kept), F.lit(0)).alias("kept_bytes"), F.coalesce(F.sum(dropped), F.lit(0)).alias("dropped_bytes"))
    share = 100.0 * F.col("dropped_bytes") / (F.col("kept_bytes") + F.col("dropped_bytes"))
    return counted.withColumn("dropped_percent", F.round(share, 6))


def width_saved(df: DataFrame, columns: tuple[str, ...] = DROP_COLUMNS) -> DataFrame:
    """What leaving out the wide columns of one table saves."""
    there = set(df.columns)
    kept, dropped = row_width(df, [c for c in df.columns if c not in columns]), row_width(df, [c for c in columns if c in there])
    return widths_saved(df.select(kept.alias("kept"), dropped.alias("dropped")), "kept", "dropped")


def drop_heavy_columns(df: DataFrame, columns: tuple[str, ...] = DROP_COLUMNS) -> DataFrame:
    """Leave out wide columns; the scan then never reads them."""
    return df.drop(*columns)
