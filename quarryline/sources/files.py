"""File listings as tables: manifests, pointer files and the empty-file audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import decoded_path
from quarryline.operators.lookup import lookup


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``name`` and ``length`` of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    )


def manifest_summary(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Object count, bytes and GiB of a listing; an empty listing gives zeros."""
    total = F.coalesce(F.sum("length"), F.lit(0)).cast("bigint")
    return (
        manifest.groupBy(*(by or []))
        .agg(F.count("*").alias("files"), total.alias("bytes"))
        .withColumn("gib", F.round(F.col("bytes") / F.lit(float(1 << 30)), 6))
    )


def empty_file_audit(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Rows per file, starting from the listing so that files without rows show as zero."""
    listing = file_manifest(spark, path, pattern)
    counted = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .parquet(path)
        .groupBy(decoded_path().alias("path"))
        .agg(F.count("*").alias("n"))
    )
    rows = F.coalesce("n", F.lit(0)).cast("bigint")
    return listing.join(counted, "path", "left").select(
        "path", "name", "length", rows.alias("rows"), (rows == 0).alias("is_empty")
    )


def read_pointer_files(spark: SparkSession, path: str, pattern: str = "*.dvc") -> DataFrame:
    """Pointer files as ``file`` and whole-file ``value``; each holds a few lines."""
    return (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(decoded_path().alias("file"), "value")
    )


# The two lines of a pointer file.
POINTER_MD5 = r"md5:\s*([0-9a-f]{32})"
POINTER_PATH = r"path:\s*([^\r\n]+)"


def parse_pointers(pointers: DataFrame) -> DataFrame:
    """Content hash, target path and object key of each pointer; incomplete ones are left out."""
    md5 = F.regexp_extract("value", POINTER_MD5, 1)
    target = F.trim(F.regexp_extract("value", POINTER_PATH, 1))
    return (
        pointers.select("file", md5.alias("md5"), target.alias("target"))
        .filter((F.col("md5") != "") & (F.col("target") != ""))
        .withColumn("object_key", F.concat(F.substring("md5", 1, 2), F.lit("/"), F.substring("md5", 3, 30)))
    )


def pointer_manifest(pointers: DataFrame, store: DataFrame) -> DataFrame:
    """Parsed pointers, each present in or missing from a store listing (``object_key``, ``length``)."""
    objects = store.groupBy("object_key").agg(F.max("length").alias("length"))
    status = F.when(F.col("length").isNotNull(), "present").otherwise("missing")
    return lookup(parse_pointers(pointers), objects, ["object_key"]).withColumn("status", status)
