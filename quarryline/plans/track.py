"""From run folders to the tracking tables: the log is parsed once and written, then read by every job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import runs
from quarryline.session import stage
from quarryline.sources import logs, sinks


@dataclass(frozen=True)
class Tracking:
    registry: DataFrame
    config: DataFrame
    latest_step: DataFrame
    best: DataFrame
    milestones: DataFrame
    tasks: DataFrame
    latest_eval: DataFrame
    core_check: DataFrame
    documents: DataFrame


def track_runs(spark: SparkSession, path: str, specs: DataFrame, url: str = "", output: str | None = None) -> Tracking:
    """All tables of the runs in ``specs``, and with ``output`` the nested JSON documents as files."""
    phases = logs.run_phases(specs)
    events = stage(runs.parse_log(logs.run_log_scan(spark, path, phases)), "events")
    tasks = stage(runs.eval_task_blocks(events), "tasks")
    milestones = runs.milestones(events)
    listed = phases.select("run").distinct()
    launched = phases.select("run", "phase_no").distinct()
    ends = launched.join(runs.latest_step(events, ("run", "phase_no")), ["run", "phase_no"], "left").na.fill(0, ["latest_step"])
    fields = specs.select(F.col("label").alias("run"), "wandb_name", "run_ids", "host", "data_variant")
    documents = sinks.tracking_documents(milestones, tasks, fields)
    if output:
        documents.write.json(output)
    return Tracking(
        registry=runs.run_registry(phases, logs.run_metadata_scan(spark, path), url),
        config=listed.join(runs.run_config(events), "run", "left"),
        latest_step=listed.join(runs.latest_step(events), "run", "left").na.fill(0, ["latest_step"]),
        best=listed.join(runs.best_metrics(events), "run", "left"),
        milestones=runs.attach_phase(runs.visible(milestones), ends),
        tasks=tasks,
        latest_eval=runs.latest_eval(tasks, milestones, listed),
        core_check=runs.core_check(tasks, milestones),
        documents=documents,
    )
