"""Training logs and run metadata files, tied to the runs they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import decoded_path
from quarryline.operators.lookup import lookup

SPEC_SCHEMA = (
    "label string, wandb_name string, run_ids array<string>, host string, "
    "run_dirs array<string>, data_variant string"
)
METADATA_SCHEMA = "gpu string, gpu_count int, startedAt string"

# Fixed value: a run's files lie in <run_dir>/files/.
RUN_DIR = r"([^/]+)/files/[^/]+$"


def run_phases(specs: DataFrame) -> DataFrame:
    """One row per phase of each run: ``run, phase_no, run_id, run_dir`` in spec order."""
    return specs.select(
        F.col("label").alias("run"),
        "wandb_name",
        "host",
        "data_variant",
        F.posexplode("run_dirs").alias("phase_no", "run_dir"),
        "run_ids",
    ).withColumn("run_id", F.get("run_ids", F.col("phase_no"))).drop("run_ids")


def run_log_scan(
    spark: SparkSession, path: str, phases: DataFrame, pattern: str = "output.log", run_dir: str = RUN_DIR
) -> DataFrame:
    """Log lines as ``run, phase_no, block, seq, line``; (phase_no, block, seq) is the reading order.

    A log may be one file or several whose names sort in writing order, and files of any size are
    split as usual: ``block`` names the file and the split's byte offset in it, ``seq`` rises within.
    Logs of unlisted run folders are left out.
    """
    offset = F.lpad(F.col("_metadata.file_block_start").cast("string"), 16, "0")
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.regexp_extract(decoded_path(), run_dir, 1).alias("run_dir"),
            F.concat_ws(":", F.col("_metadata.file_name"), offset).alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").alias("line"),
        )
    )
    owner = phases.select("run_dir", "run", "phase_no")
    return (
        lookup(lines, owner, ["run_dir"])
        .filter(F.col("run").isNotNull())
        .select("run", "phase_no", "block", "seq", "line")
    )


def run_metadata_scan(spark: SparkSession, path: str, pattern: str = "*metadata.json") -> DataFrame:
    """``run_dir, gpu, gpu_count, startedAt`` of every metadata file."""
    return (
        spark.read.schema(METADATA_SCHEMA)
        .option("multiLine", True)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .json(path)
        .select(F.regexp_extract(decoded_path(), RUN_DIR, 1).alias("run_dir"), "*")
    )
