"""Streaming queries: each runs over the given table as a stream and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.catalog import sampling as sampled
from quarryline.catalog.corpus import ROWS_PER_SHARD
from quarryline.catalog.tables import EVENTS_SQL, log_lines, table
from quarryline.catalog.tracking import run_phases
from quarryline.operators.placement import stripe_files
from quarryline.session import new_folder
from quarryline.streaming import jobs, tail


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return jobs.stream_table(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


def stream_sample_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "sample")
    key = F.col("doc_id").cast("string")
    source = _stream(spark, sf_dir, "documents")
    jobs.stream_sample_ingest(source, key, sampled.RATIO, f"{out}/rows", f"{out}/checkpoint", sampled.SEED).awaitTermination()
    return jobs.read_stream_shards(spark, f"{out}/rows").select("doc_id", "source", F.md5("text").alias("text_md5"))


def stream_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arriving documents in shards of 70 rows: rows and places of each shard."""
    out = new_folder(spark, "stream-shards")
    jobs.stream_shards(_stream(spark, sf_dir, "documents").select("doc_id", "n_chars"), f"{out}/rows", f"{out}/checkpoint", ROWS_PER_SHARD).awaitTermination()
    rows = jobs.read_stream_shards(spark, f"{out}/rows")
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.min("row_in_shard").alias("first"), F.max("row_in_shard").alias("last"))


def stream_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "milestones")
    lines = log_lines(_stream(spark, sf_dir, "events"))
    jobs.stream_milestones(lines, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return jobs.latest_snapshot(spark, f"{out}/rows")


def stream_milestones_tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same milestones from text logs, of which the job sees the first phases before the others are there."""
    out = new_folder(spark, "tailed")
    lines = log_lines(table(spark, sf_dir, "events")).withColumn("folder", F.concat_ws("-", "run", F.col("phase_no").cast("string")))
    for phases in ("phase_no < 2", "phase_no >= 2"):
        arriving = lines.filter(phases).repartitionByRange("folder", "seq").sortWithinPartitions("folder", "seq")
        arriving.select("folder", "line").write.partitionBy("folder").mode("append").text(f"{out}/logs")
        tailed = tail.tail_logs(spark, f"{out}/logs", run_phases(spark), "*.txt", r"folder=([^/]+)/")
        jobs.stream_milestones(tailed, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return jobs.latest_snapshot(spark, f"{out}/rows")


def stream_transfer_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings of files that grow: a file is seen with a part of its size several times."""
    out = new_folder(spark, "growth")
    number = F.floor(F.col("event_id") / 5)
    name, length = F.concat(F.lit("shard_"), F.lpad(number.cast("string"), 8, "0")), number % 1000 + 1
    files = table(spark, sf_dir, "events").select(name.alias("name"), length.alias("length")).distinct()
    arrived = _stream(spark, sf_dir, "events").select(name.alias("name"), F.expr("div(floor(event_id / 5) % 1000 + 1, event_id * 7 % 4 + 1)").alias("length"))
    manifest = stripe_files(files, 6).select("name", "worker", "length")
    jobs.stream_transfer_progress(arrived, manifest, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return jobs.progress_report(jobs.latest_snapshot(spark, f"{out}/rows"), manifest)


def stream_transfer_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file arrivals: one file per five events, most arriving more than once."""
    out = new_folder(spark, "progress")
    number = F.floor(F.col("event_id") / 5)
    name, length = F.concat(F.lit("shard_"), F.lpad(number.cast("string"), 8, "0")), number % 1000 + 1
    files = table(spark, sf_dir, "events").select(name.alias("name"), length.alias("length")).distinct()
    arrived = _stream(spark, sf_dir, "events").filter("event_type in ('view', 'click') and event_id % 3 <> 0").select(name.alias("name"), length.alias("length"))
    manifest = stripe_files(files, 6).select("name", "worker", "length")
    jobs.stream_transfer_progress(arrived, manifest, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return jobs.progress_report(jobs.latest_snapshot(spark, f"{out}/rows"), manifest)


QUERIES = {f.__name__: f for f in (stream_sample_ingest, stream_shard_sizes, stream_milestones, stream_milestones_tailed, stream_transfer_growth, stream_transfer_progress)}

ORACLE = {
    "stream_sample_ingest": f"SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE {sampled._KEEP}",
    "stream_shard_sizes": f"""
      WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT n, unnest(range(ceil(n / {ROWS_PER_SHARD}::DOUBLE)::BIGINT)) AS i FROM n)
      SELECT 'shard_' || lpad(i::VARCHAR, 5, '0') AS shard, least({ROWS_PER_SHARD}, n - {ROWS_PER_SHARD} * i) AS rows, 0::BIGINT AS first,
        least({ROWS_PER_SHARD}, n - {ROWS_PER_SHARD} * i) - 1 AS last FROM s""",
    "stream_milestones": f"WITH {EVENTS_SQL} SELECT run, step, val, core, cdpk, n, d::BIGINT AS d, last_phase FROM ms",
    "stream_milestones_tailed": f"WITH {EVENTS_SQL} SELECT run, step, val, core, cdpk, n, d::BIGINT AS d, last_phase FROM ms",
    "stream_transfer_growth": """
      WITH seen AS (SELECT event_id // 5 AS k, max((event_id // 5 % 1000 + 1) // (event_id * 7 % 4 + 1)) AS largest FROM events GROUP BY 1),
      striped AS (SELECT k, largest, (row_number() OVER (ORDER BY k) - 1) % 6 AS worker, k % 1000 + 1 AS length FROM seen)
      SELECT worker, count(*) AS files, sum(largest)::BIGINT AS bytes, round(100::DOUBLE * count(*) / count(*), 6) AS files_percent,
        round(100::DOUBLE * sum(largest)::BIGINT / sum(length)::BIGINT, 6) AS bytes_percent FROM striped GROUP BY worker""",
    "stream_transfer_progress": """
      WITH files AS (SELECT DISTINCT event_id // 5 AS k FROM events), striped AS (SELECT k, (row_number() OVER (ORDER BY k) - 1) % 6 AS worker, k % 1000 + 1 AS length FROM files),
      here AS (SELECT DISTINCT event_id // 5 AS k, true AS arrived FROM events WHERE event_type IN ('view', 'click') AND event_id % 3 <> 0)
      SELECT worker, count(arrived) AS files, coalesce(sum(length) FILTER (arrived), 0)::BIGINT AS bytes, round(100::DOUBLE * count(arrived) / count(*), 6) AS files_percent,
        round(100::DOUBLE * coalesce(sum(length) FILTER (arrived), 0)::BIGINT / sum(length)::BIGINT, 6) AS bytes_percent
      FROM striped LEFT JOIN here USING (k) GROUP BY worker""",
}
