"""Ordered fixed-size shards, nested evaluation results, and versioned publishing."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.keys import column_names, key_struct, sort_columns, with_bucket
from quarryline.operators.order import MAX_BUCKETS, global_rank, split

ROWS_PER_SHARD = 14_000
ROWS_PER_TASK = 200_000


def with_shards(
    df: DataFrame, order: list[str], rows_per_shard: int, rows_per_task: int = ROWS_PER_TASK, keys: DataFrame | None = None
) -> DataFrame:
    """Add ``rank``, ``shard_id`` and ``row_in_shard``, each task holding whole shards in order.

    The order columns are ranked first to find the last key of every task; the full rows are then
    shuffled once, straight to the task that owns their shards. ``keys`` may be a staged table of the same
    rows' order columns, where ``df`` is a join that should not run once more for them.
    """
    return _with_shards(df, order, rows_per_shard, rows_per_task, keys)[0]


def shards_per_task(spark: SparkSession, shards: int, rows_per_shard: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """How many whole shards a task takes: fewer than its rows allow where some slots would get none."""
    fair = math.ceil(shards / spark.sparkContext.defaultParallelism)
    return max(1, min(rows_per_task // rows_per_shard, fair), math.ceil(shards / MAX_BUCKETS))


def _with_shards(
    df: DataFrame, order: list[str], rows_per_shard: int, rows_per_task: int, keys: DataFrame | None
) -> tuple[DataFrame, int]:
    if rows_per_shard <= 0:
        raise ValueError("rows_per_shard must be positive")
    narrow = (df if keys is None else keys).select(*column_names(order))
    cut = split(narrow, order)
    shards = math.ceil(cut.total_rows / rows_per_shard)
    per_task = shards_per_task(df.sparkSession, shards, rows_per_shard, rows_per_task)
    task_rows = per_task * rows_per_shard
    tasks = max(1, math.ceil(shards / per_task))
    ends = []
    if tasks > 1:
        last_of_task = (F.col("rank") + 1) % task_rows == 0
        found = (
            global_rank(narrow, order, cut=cut)
            .filter(last_of_task & (F.col("rank") + 1 < cut.total_rows))
            .select("rank", key_struct(narrow, order).alias("key"))
            .collect()
        )
        ends = [row["key"].asDict() for row in sorted(found, key=lambda row: row["rank"])]
    owned = with_bucket(df, order, ends, cut.key_type, "_task")
    in_order = Window.partitionBy("_task").orderBy(*sort_columns(order))
    placed = (
        owned.repartitionById(tasks, F.col("_task"))
        .withColumn("rank", (F.col("_task").cast("bigint") * task_rows + F.row_number().over(in_order) - 1))
        .drop("_task")
        .withColumn("shard_id", F.expr(f"rank div {int(rows_per_shard)}"))
        .withColumn("row_in_shard", F.col("rank") % rows_per_shard)
    )
    return placed, shards


def write_sharded(
    df: DataFrame,
    path: str,
    order: list[str],
    rows_per_shard: int = ROWS_PER_SHARD,
    columns: list[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    keys: DataFrame | None = None,
) -> str:
    """Write one zstd Parquet file per shard, rows in order, and publish it as the current version.

    Shards are files ``shard_00012.parquet`` in the returned version folder, with the wanted columns only. Every shard holds
    ``rows_per_shard`` rows but the last. Earlier versions stay until someone removes them. ``keys`` is as in :func:`with_shards`.
    """
    version = write_version(df, path, order, rows_per_shard, columns, rows_per_task, keys)
    publish(df.sparkSession, path, version)
    return version


def write_version(
    df: DataFrame,
    path: str,
    order: list[str],
    rows_per_shard: int = ROWS_PER_SHARD,
    columns: list[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    keys: DataFrame | None = None,
) -> str:
    """The same without publishing, for callers that put more into the version's folder first."""
    version = f"{path}/version-{uuid.uuid4().hex}"
    placed, shards = _with_shards(df, order, rows_per_shard, rows_per_task, keys)
    write_shard_files(placed.sortWithinPartitions("rank"), version, columns or df.columns, rows_per_shard, range(shards))
    return version


#: Renames in flight at once; each is one call to the file system.
RENAMES_AT_ONCE = 32
# Fixed value: the name of a shard's file.
SHARD_FILE = "shard_{:05d}.parquet"


def write_shard_files(
    placed: DataFrame, folder: str, columns: list[str], rows_per_shard: int, shards: range, place: Callable[[int], str] = lambda shard: ""
) -> None:
    """Write rows that stand in tasks of whole shards, both in order, as one flat file for each of ``shards``.

    Every task begins a file after ``rows_per_shard`` rows, so the files below ``_parts``, by the numbers of task and file in their names, are
    the shards in turn; the committer keeps those of one attempt per task. Then every file gets its name
    in ``folder``, or the folder below it that ``place`` gives for the shard. Nobody looks there before the caller's marker, so a
    driver that is lost meanwhile leaves an unnamed folder and no half version.
    """
    spark, parts = placed.sparkSession, f"{folder}/_parts"
    rows = placed.select(*columns)
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(parts)
    if not shards:
        return
    found = sorted(spark.read.schema(rows.schema).parquet(parts).inputFiles(), key=_task_and_file)
    if len(found) != len(shards):
        raise RuntimeError(f"{len(found)} files for {len(shards)} shards: the rows were not placed by shard")
    _, fs = file_system(spark, parts)
    path, uri = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jvm.java.net.URI
    for below in sorted({place(shard) for shard in shards}):
        fs.mkdirs(path(f"{folder}/{below}"))

    def rename(source: str, shard: int) -> None:
        target = "/".join(x for x in (folder, place(shard), SHARD_FILE.format(shard)) if x)
        if not fs.rename(path(uri(source)), path(target)):
            raise RuntimeError(f"could not rename {source} to {target}")

    with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
        list(pool.map(rename, found, shards))


def _task_and_file(source: str) -> tuple[int, int]:
    """The numbers in the name of a file that Spark wrote."""
    task, file = re.search(r"/part-(\d+)-[^/]*-c(\d+)\.[^/]*$", source).groups()
    return int(task), int(file)


def shard_columns() -> list[Column]:
    """A row's shard and place in it, from the file it was read from."""
    name = F.regexp_extract("_metadata.file_name", r"^(shard_(\d+))\.parquet$", 1)
    number = F.regexp_extract("_metadata.file_name", r"^(shard_(\d+))\.parquet$", 2).cast("bigint")
    return [name.alias("shard"), number.alias("shard_id"), F.col("_metadata.row_index").alias("row_in_shard")]


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a sharded dataset, with each row's ``shard``, ``shard_id`` and ``row_in_shard``."""
    return spark.read.parquet(current_version(spark, path)).select(*shard_columns(), "*")


def file_system(spark: SparkSession, path: str):
    """A path and the file system it lies in, as Spark reaches it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Name a finished version as current by adding a numbered marker; readers take the highest."""
    number = _last_marker(spark, path) + 1
    write_marker(spark, f"{path}/_current-{number:08d}", version.rsplit("/", 1)[1])


def write_marker(spark: SparkSession, file: str, content: str) -> None:
    """A small file that must not be there yet."""
    marker, fs = file_system(spark, file)
    stream = fs.create(marker, False)
    stream.write(bytearray(content, "utf-8"))
    stream.close()


def read_marker(spark: SparkSession, file: str) -> str:
    marker, fs = file_system(spark, file)
    stream = fs.open(marker)
    content = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return content


def markers(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names of the marker files below a folder that may not exist, in order."""
    target, fs = file_system(spark, folder)
    if not fs.exists(target):
        return []
    return sorted(n for n in (status.getPath().getName() for status in fs.listStatus(target)) if n.startswith(prefix))


def _last_marker(spark: SparkSession, path: str) -> int:
    return max((int(n.removeprefix("_current-")) for n in markers(spark, path, "_current-")), default=0)


def published(spark: SparkSession, path: str) -> str:
    """The current version below a path, or the path itself where nothing was published with a marker."""
    return current_version(spark, path) if _last_marker(spark, path) else path


def current_version(spark: SparkSession, path: str) -> str:
    number = _last_marker(spark, path)
    if number == 0:
        raise FileNotFoundError(f"nothing published under {path}")
    return f"{path}/{read_marker(spark, f'{path}/_current-{number:08d}')}"


ROWS_PER_RESULT_FILE = 100_000


def write_results(summary: DataFrame, scored: DataFrame, path: str, aggregate: DataFrame | None = None, mode: str = "error") -> None:
    """Evaluation output: ``runs`` and ``aggregate`` as CSV, ``rows`` as JSON lines below a folder per run.

    ``summary`` has one row per (checkpoint, seed), ``scored`` one per (checkpoint, seed, qid). A
    run's examples go to about one file per ``ROWS_PER_RESULT_FILE``, so that large runs are written by many tasks. With the
    mode ``append`` runs are added to those that are there; ``aggregate`` is then that of all of them.
    """
    if aggregate is not None:
        aggregate.write.option("header", True).mode("overwrite" if mode == "append" else mode).csv(f"{path}/aggregate")
    fields = [c for c in scored.columns if c not in ("checkpoint", "seed")]
    nested = scored.select("checkpoint", "seed", F.struct(*fields).alias("result"))
    largest = scored.groupBy("checkpoint", "seed").count().agg(F.max("count").alias("n")).first()["n"] or 0
    part = F.pmod(F.xxhash64("result"), F.lit(1 + largest // ROWS_PER_RESULT_FILE))
    nested.repartition("checkpoint", "seed", part).write.partitionBy("checkpoint", "seed").mode(mode).json(f"{path}/rows")
    summary.write.option("header", True).mode(mode).csv(f"{path}/runs")  # last: a run listed here is done


def tracking_documents(milestones: DataFrame, tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """One document per (run, step) that has tasks, nested as the tracking file has it.

    ``tasks`` has ``run, step, task_no, task, shots, type, accuracy, centered``; the tasks of one evaluation
    are one document however many they are. ``runs`` may bring fields of the run besides its name. Runs without
    tasks keep one row with null step.
    """
    entry = F.struct("task_no", "task", "shots", "type", "accuracy", "centered")
    per_step = tasks.groupBy("run", "step").agg(F.sort_array(F.collect_list(entry)).alias("tasks"))
    steps = per_step.join(milestones, ["run", "step"], "left").select(
        "run",
        "step",
        F.col("core"),
        F.col("val").alias("val_bpb"),
        F.when(F.col("cdpk").isNotNull(), F.struct(F.col("cdpk").alias("acc"), "n", "d")).alias("cdpk"),
        "tasks",
    )
    return runs.join(steps, "run", "left")
