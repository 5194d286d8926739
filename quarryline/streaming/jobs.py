"""Incremental ingest, live milestones and transfer progress as Structured Streaming jobs.

Each job takes a streaming DataFrame and runs with ``availableNow``: it handles what has arrived
since its checkpoint and stops. Starting it again picks up where it left off.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.operators.manifests import percent
from quarryline.operators.quality import drop_blank_text
from quarryline.operators.runs import milestones, parse_log
from quarryline.operators.sampling import hash_sample
from quarryline.session import stage
from quarryline.sources import sinks
from quarryline.sources.sinks import ROWS_PER_SHARD


def stream_folder(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table as a stream of its files, whether the path is one Parquet file or a folder of them."""
    target, fs = sinks.file_system(spark, path)
    if fs.getFileStatus(target).isDirectory():
        return stream_folder(spark, path, schema)
    folder, _, name = path.rpartition("/")
    return stream_folder(spark, folder, schema, name)


def stream_sample_ingest(
    source: DataFrame,
    key: Column,
    ratio: float,
    output: str,
    checkpoint: str,
    seed: int = 42,
    text: str = "text",
    rows_per_shard: int = ROWS_PER_SHARD,
) -> StreamingQuery:
    """Blank filter and hash sample of arriving rows into shards of a fixed size; equals the batch sample of the same rows."""
    return stream_shards(hash_sample(drop_blank_text(source, text), key, ratio, seed), output, checkpoint, rows_per_shard)


_COMMIT = "_batch-"
# monotonically_increasing_id: the task above these bits, the row within it below.
_TASK_BITS = 33


@dataclass(frozen=True)
class _Progress:
    """What the batches so far have written."""

    rows: int = 0
    folders: tuple[str, ...] = ()
    tail: str = ""

    @classmethod
    def read(cls, spark: SparkSession, output: str, before: int | None = None) -> _Progress:
        """The state after the last batch, or after the last one with a smaller number."""
        names = [n for n in sinks.markers(spark, output, _COMMIT) if before is None or int(n.removeprefix(_COMMIT)) < before]
        if not names:
            return cls()
        last = json.loads(sinks.read_marker(spark, f"{output}/{names[-1]}"))
        return cls(last["rows"], tuple(last["folders"]), last["tail"])


def stream_shards(rows: DataFrame, output: str, checkpoint: str, rows_per_shard: int = ROWS_PER_SHARD) -> StreamingQuery:
    """Arriving rows as files ``shard_00012.parquet`` of exactly ``rows_per_shard`` rows; the last one may be shorter.

    The row count and the short last shard are carried from batch to batch in a marker per batch, written when
    its shards stand. A batch continues the numbering of the markers before it. One that Spark repeats finds its own marker
    and does nothing, or finds none and writes a folder of its own again, so every row is in one shard however often the job
    stops. Files of other shards are never rewritten; read the result with :func:`read_stream_shards`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, marker = batch.sparkSession, f"{_COMMIT}{batch_id:012d}"
        if marker in sinks.markers(spark, output, marker):
            return
        done = _Progress.read(spark, output, batch_id)
        arrived = stage(batch.withColumn("_n", F.monotonically_increasing_id()), "arrived")
        by_task = arrived.groupBy(F.shiftright("_n", _TASK_BITS).alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
        total = done.rows + sum(t["n"] for t in by_task)
        first, whole = done.rows // rows_per_shard, total // rows_per_shard
        progress = {"rows": total, "folders": list(done.folders), "tail": done.tail}
        if total > done.rows:
            start, starts = done.rows, []
            for t in by_task:
                starts.append((t["task"], start))
                start += t["n"]
            offsets = F.create_map(*(F.lit(x).cast("bigint") for pair in starts for x in pair))
            ranked = arrived.withColumn("_rank", F.element_at(offsets, F.shiftright("_n", _TASK_BITS)) + F.col("_n").bitwiseAND((1 << _TASK_BITS) - 1)).drop("_n")
            if done.tail:
                tail = spark.read.schema(batch.schema).parquet(done.tail).select("*", (F.lit(first * rows_per_shard) + F.col("_metadata.row_index")).alias("_rank"))
                ranked = tail.unionByName(ranked)
            shards = -(-total // rows_per_shard) - first
            per_task = sinks.shards_per_task(spark, shards, rows_per_shard)
            placed = (
                ranked.withColumn("shard_id", F.expr(f"_rank div {int(rows_per_shard)}"))
                .repartitionById(-(-shards // per_task), F.expr(f"(shard_id - {first}) div {per_task}").cast("int"))
                .sortWithinPartitions("_rank")
            )
            folder = f"{output}/{marker.removeprefix('_')}-{uuid.uuid4().hex}"
            made = range(first, first + shards)
            sinks.write_shard_files(placed, folder, batch.columns, rows_per_shard, made, lambda shard: "whole" if shard < whole else "tail")
            progress["folders"] += [f"{folder}/whole"] if whole > first else []
            progress["tail"] = f"{folder}/tail" if total % rows_per_shard else ""
        sinks.write_marker(spark, f"{output}/{marker}", json.dumps(progress))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream_shards(spark: SparkSession, output: str) -> DataFrame:
    """All shards that finished batches have written, with ``shard``, ``shard_id`` and ``row_in_shard``."""
    done = _Progress.read(spark, output)
    paths = [*done.folders, *([done.tail] if done.tail else [])]
    if not paths:
        raise FileNotFoundError(f"no finished batch with rows under {output}")
    return spark.read.parquet(*paths).select(*sinks.shard_columns(), "*")


def _write_snapshots(result: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write the complete result of each batch to its own folder; a repeated batch rewrites its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id:012d}")

    return (
        result.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _snapshots(spark: SparkSession, output: str, before: int | None = None) -> list[str]:
    """Folders of finished batches in order, up to the one before a batch."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(output)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    batches = sorted(s.getPath().toString() for s in fs.listStatus(folder) if "batch=" in s.getPath().getName())
    if before is not None:
        batches = [b for b in batches if int(b.rpartition("=")[2]) < before]
    return [b for b in batches if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{b}/_SUCCESS"))]


def latest_snapshot(spark: SparkSession, output: str) -> DataFrame:
    """The result of the newest batch written by a snapshot job."""
    return spark.read.parquet(_snapshots(spark, output)[-1])


def stream_milestones(lines: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """The milestone table of all log lines so far; the state is one row per (run, step).

    ``lines`` may come from a folder of new files or from logs that grow (:func:`quarryline.streaming.tail.tail_logs`).
    """
    return _write_snapshots(milestones(parse_log(lines)), output, checkpoint)


#: How long a finished file is remembered after it was last seen.
KEEP_FINISHED_DAYS = 30
_CHANGE = "worker bigint, files bigint, bytes bigint"
#: Per file of a numbering: its number in it, its largest size, and when it is forgotten (ms; null while it grows).
_SIZES = "numbers array<int>, sizes array<bigint>, forget_at array<bigint>"
#: The last run of five or more digits that stands alone; its last three digits tell the files of a numbering apart.
_NUMBERED = r"(?s)^(.*(?<![0-9A-Za-z])[0-9]{2,})([0-9]{3})((?![0-9A-Za-z]).*)$"


def _numbering(name: Column) -> tuple[Column, Column]:
    """The numbering a file name belongs to and the file's number in it, below 1,000.

    ``shard_00012.parquet`` is number 12 of ``shard_00###.parquet``. Any other name is a numbering of its own, with number -1.
    """
    number = F.regexp_extract(name, _NUMBERED, 2)
    return F.regexp_replace(name, _NUMBERED, "$1###$3"), F.when(number == "", -1).otherwise(number.cast("int"))


def _largest_sizes(keep_ms: int):
    """Per numbering of files: what a batch adds to the counts of the workers.

    The largest size wins, so a file listed while it grows, or listed again, or out of turn, counts once with its full size. A
    growing file stays in the state. A finished one, as long as the manifest says, is forgotten when it has not been
    seen for a while: every sighting starts the time anew, so what is still listed is never counted twice.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        before = {number: (size, forget_at) for number, size, forget_at in zip(*state.get)} if state.exists else {}
        listed: dict[int, tuple] = {}
        for frame in () if state.hasTimedOut else frames:
            for number, length, worker, whole in zip(*(frame[c].tolist() for c in ("number", "length", "worker", "whole"))):
                listed[number] = (max(length, listed[number][0]) if number in listed else length, worker, whole)
        kept = {number: file for number, file in before.items() if number not in listed and (file[1] is None or file[1] >= now)}
        changes = []
        for number, (length, worker, whole) in listed.items():
            counted = before[number][0] if number in before else 0
            largest = max(length, counted)
            kept[number] = (largest, now + keep_ms if not pd.isna(whole) and largest >= whole else None)
            if number not in before or largest > counted:
                changes.append((worker, int(number not in before), largest - counted))
        if not kept:
            state.remove()
            return
        state.update(tuple(map(list, zip(*((number, *file) for number, file in kept.items())))))
        times = [forget_at for _, forget_at in kept.values() if forget_at is not None]
        if times:
            state.setTimeoutDuration(max(1, min(times) - now))
        if changes:
            yield pd.DataFrame(changes, columns=["worker", "files", "bytes"])

    return update


def stream_transfer_progress(
    arrived: DataFrame, manifest: DataFrame, output: str, checkpoint: str, keep_finished_days: float = KEEP_FINISHED_DAYS
) -> StreamingQuery:
    """Files and bytes per worker so far; a file seen again counts once, with the largest size it was seen with.

    ``arrived`` has ``name, length``, ``manifest`` ``name, worker, length``. Files the manifest lacks are left out, so the state is at most
    one size per file of the manifest. Files of one numbering, up to 1,000 and one, share a row of the state and a call, as a call of the
    keyed function costs far more than a file in it. The manifest is written once when the job starts, not computed for every batch. Each
    batch adds its changes to the totals of the batch before, which stand in that batch's folder.
    """
    spark = arrived.sparkSession
    parts = stage(manifest.groupBy("name").agg(F.max("worker").cast("bigint").alias("worker"), F.max("length").cast("bigint").alias("whole")), "manifest")
    listed = arrived.select("name", F.coalesce(F.col("length").cast("bigint"), F.lit(0)).alias("length")).join(parts, "name")
    numbering, number = _numbering(F.col("name"))
    keep_ms = max(1, int(keep_finished_days * 86_400_000))
    changes = (
        listed.select(numbering.alias("name"), number.alias("number"), "length", "worker", "whole")
        .groupBy("name")
        .applyInPandasWithState(_largest_sizes(keep_ms), _CHANGE, _SIZES, "update", GroupStateTimeout.ProcessingTimeTimeout)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        earlier = _snapshots(spark, output, batch_id)
        totals = batch.unionByName(spark.read.schema(batch.schema).parquet(earlier[-1])) if earlier else batch
        totals = totals.groupBy("worker").agg(F.sum("files").cast("bigint").alias("files"), F.sum("bytes").cast("bigint").alias("bytes"))
        totals.write.mode("overwrite").parquet(f"{output}/batch={batch_id:012d}")

    # With timeouts by the clock, empty batches would follow each other for ever: what has timed out goes with the next arrivals.
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")  # the query keeps the settings it starts with
    try:
        return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def progress_report(snapshot: DataFrame, manifest: DataFrame) -> DataFrame:
    """A progress snapshot in percent of each worker's part of the manifest, idle workers included."""
    parts = manifest.groupBy("worker").agg(F.count("*").alias("all_files"), F.sum("length").alias("all_bytes"))
    shown = parts.join(snapshot, "worker", "left").na.fill(0, ["files", "bytes"])
    return shown.select(
        "worker",
        "files",
        "bytes",
        percent(F.col("files"), F.col("all_files")).alias("files_percent"),
        percent(F.col("bytes"), F.col("all_bytes")).alias("bytes_percent"),
    )
