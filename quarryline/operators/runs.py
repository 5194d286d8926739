"""Milestones, best metrics, evaluation blocks and the registry of training runs.

All jobs read the event table of :func:`parse_log`: one row per recognised line with ``run``,
``phase_no``, ``block``, ``seq`` and the parsed fields. ``(phase_no, block, seq)`` orders the lines
of a run over all its phases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.logs import event_fields, line_events
from quarryline.operators.lookup import lookup

CORE_TOLERANCE = 5e-4


def parse_log(lines: DataFrame) -> DataFrame:
    """Typed events of ``run, phase_no, block, seq, line`` rows; other lines are dropped."""
    place = ["run", "phase_no", "block", "seq"]
    found = lines.select(*place, F.inline(line_events(F.col("line"))))
    return found.select(*place, "kind", *event_fields(F.col("kind"), F.col("groups")))


def _position() -> Column:
    return F.struct("phase_no", "block", "seq")


def _at(kind: str) -> Column:
    """The line position of events of one kind, null for others."""
    return F.when(F.col("kind") == kind, _position())


def latest_step(events: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The highest training step seen, 0 where no step line was."""
    step = F.max(F.when(F.col("kind") == "step", F.col("step")))
    return events.groupBy(*by).agg(F.coalesce(step, F.lit(0)).cast("bigint").alias("latest_step"))


def milestones(events: DataFrame) -> DataFrame:
    """Per (run, step) the last logged validation, CORE and CDPK values and the phase that logged last."""
    metric = events.filter(F.col("kind").isin("val", "core", "cdpk"))
    cdpk = F.max_by(F.struct("value", "n", "d"), _at("cdpk"))
    return (
        metric.groupBy("run", "step")
        .agg(
            F.max_by("value", _at("val")).alias("val"),
            F.max_by("value", _at("core")).alias("core"),
            cdpk.alias("_cdpk"),
            F.max_by("phase_no", _position()).alias("last_phase"),
        )
        .select("run", "step", "val", "core", F.col("_cdpk.value").alias("cdpk"), "_cdpk.n", "_cdpk.d", "last_phase")
    )


def visible(milestone_rows: DataFrame) -> DataFrame:
    """Milestones as the table shows them: without step 0."""
    return milestone_rows.filter(F.col("step") > 0)


def best_metrics(events: DataFrame) -> DataFrame:
    """Per run the lowest validation and highest CORE and CDPK values; the first line wins a tie."""
    row = F.struct("step", "value", "n", "d")

    def best(kind: str, rank: Column) -> Column:
        return F.min_by(row, F.when(F.col("kind") == kind, F.struct(rank.alias("by"), _position().alias("at"))))

    value = F.col("value")
    found = events.groupBy("run").agg(
        best("val", value).alias("val"), best("core", -value).alias("core"), best("cdpk", -value).alias("cdpk")
    )
    return found.select(
        "run",
        F.col("val.value").alias("best_val"),
        F.col("val.step").alias("best_val_step"),
        F.col("core.value").alias("best_core"),
        F.col("core.step").alias("best_core_step"),
        F.col("cdpk.value").alias("best_cdpk"),
        F.col("cdpk.step").alias("best_cdpk_step"),
        F.col("cdpk.n").alias("best_cdpk_n"),
        F.col("cdpk.d").alias("best_cdpk_d"),
    )


def run_config(events: DataFrame) -> DataFrame:
    """Planned iterations, tokens and batch size: the first line of each form, computed before fixed."""
    def first(kind: str) -> Column:
        return F.min_by("n", _at(kind))

    return events.groupBy("run").agg(
        F.coalesce(first("iterations_auto"), first("iterations_fixed")).alias("planned_iterations"),
        first("tokens").alias("planned_tokens"),
        F.coalesce(first("batch_auto"), first("batch_total")).alias("batch_size_tokens"),
    )


def eval_task_blocks(events: DataFrame) -> DataFrame:
    """Task scores under the step of the CORE line that follows them, numbered within their block.

    Of several blocks for one step the later one stays; tasks without a later CORE line drop out.
    Windows run over one split of the log at a time, and a row per split carries the next CORE line
    and the count of tasks still open across splits, so a run of any length is shared by many tasks.
    """
    split = ["run", "phase_no", "block"]
    lines = events.filter(F.col("kind").isin("task", "core"))
    is_task = F.col("kind") == "task"
    core = F.when(~is_task, F.struct(_position().alias("at"), F.col("step").alias("step")))
    by_line = Window.partitionBy(*split).orderBy("seq", F.desc("kind"))
    so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by_line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    inside = (
        lines.withColumn("_core", core)
        .withColumn("_next", F.first("_core", ignorenulls=True).over(ahead))
        .withColumn("_seen", F.sum(is_task.cast("bigint")).over(so_far))
        .withColumn("_closed", F.max(F.when(~is_task, F.col("_seen"))).over(so_far))
    )
    by_split = Window.partitionBy("run").orderBy("phase_no", "block")
    earlier = by_split.rowsBetween(Window.unboundedPreceding, -1)
    later = by_split.rowsBetween(1, Window.unboundedFollowing)
    around = (
        inside.groupBy(*split)
        .agg(F.min("_core").alias("_first"), F.max("_seen").alias("_tasks"), F.max("_closed").alias("_closed"))
        .withColumn("_beyond", F.first("_first", ignorenulls=True).over(later))
        .withColumn("_before", F.coalesce(F.sum("_tasks").over(earlier), F.lit(0)))
        .withColumn("_open", F.col("_before") - F.coalesce(F.max(F.col("_before") + F.col("_closed")).over(earlier), F.lit(0)))
        .select(*split, "_beyond", "_open")
    )
    number = F.col("_seen") - 1 + F.when(F.col("_closed").isNull(), F.col("_open")).otherwise(-F.col("_closed"))
    owner = F.coalesce("_next", "_beyond")
    owned = (
        inside.filter(is_task)
        .join(around, split)
        .filter(owner.isNotNull())
        .select(
            "run",
            owner["step"].alias("step"),
            owner["at"].alias("core_at"),
            number.alias("task_no"),
            "task",
            "shots",
            "type",
            "accuracy",
            "centered",
        )
    )
    last = owned.groupBy("run", "step").agg(F.max("core_at").alias("core_at"))
    return owned.join(last, ["run", "step", "core_at"], "left_semi").drop("core_at")


def latest_eval(tasks: DataFrame, milestone_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The tasks of each run's last evaluated step with its CORE; runs without any show ``has_tasks`` false."""
    last = tasks.groupBy("run").agg(F.max("step").alias("step"))
    scored = last.join(milestone_rows.select("run", "step", "core"), ["run", "step"], "left").withColumn("has_tasks", F.lit(True))
    shown = lookup(tasks, scored, ["run", "step"]).filter(F.col("has_tasks"))
    listed = lookup(shown, runs.select("run", F.lit(True).alias("_listed")), ["run"]).filter(F.col("_listed"))
    idle = runs.select("run").join(last, "run", "left_anti").withColumn("has_tasks", F.lit(False))
    return listed.drop("_listed").unionByName(idle, allowMissingColumns=True)


def core_check(tasks: DataFrame, milestone_rows: DataFrame, tolerance: float = CORE_TOLERANCE) -> DataFrame:
    """CORE recomputed as the mean of centered task scores, beside the logged value."""
    mean = tasks.groupBy("run", "step").agg(F.avg("centered").alias("mean_centered"), F.count("*").alias("tasks"))
    logged = milestone_rows.filter(F.col("core").isNotNull()).select("run", "step", "core")
    return logged.join(mean, ["run", "step"]).select(
        "run",
        "step",
        "tasks",
        "core",
        F.round("mean_centered", 6).alias("mean_centered"),
        (F.abs(F.col("core") - F.col("mean_centered")) < tolerance).alias("agrees"),
    )


def phase_name(index: Column) -> Column:
    return F.concat(F.lit("phase "), F.char(index + ord("A")))


def attach_phase(milestone_rows: DataFrame, phases: DataFrame) -> DataFrame:
    """Label each milestone with the first phase whose last step reaches it, else the last phase.

    ``phases`` has ``run, phase_no, latest_step``. Runs of one phase get an empty label. The phases
    of a run are its launches, a short list.
    """
    ends = phases.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("phase_no", "latest_step"))).alias("_ends"))
    joined = lookup(milestone_rows, ends, ["run"]).filter(F.col("_ends").isNotNull())
    reached = F.filter("_ends", lambda end: end["latest_step"] >= F.col("step"))
    index = F.coalesce(F.get(reached, F.lit(0)), F.element_at("_ends", -1))["phase_no"].cast("int")
    label = F.when(F.size("_ends") == 1, F.lit("")).otherwise(phase_name(index))
    return joined.withColumn("phase", label).drop("_ends")


def run_registry(phases: DataFrame, metadata: DataFrame, url: str = "") -> DataFrame:
    """One row per run: ids, start times and links joined with " + ", the last phase's GPUs."""
    rows = phases.join(metadata, "run_dir", "left").withColumn(
        "started", F.replace(F.translate("startedAt", "T", " "), F.lit("Z"), F.lit(""))
    )
    steps = F.sort_array(F.collect_list(F.struct("phase_no", "run_id", "started")))
    grouped = rows.groupBy("run").agg(
        F.first("wandb_name").alias("wandb_name"),
        F.first("host").alias("host"),
        F.first("data_variant").alias("data_variant"),
        steps.alias("_steps"),
        F.max_by(F.struct("gpu", "gpu_count"), "phase_no").alias("_gpu"),
    )

    def joined(value) -> Column:
        return F.array_join(F.transform("_steps", value), " + ")

    return grouped.select(
        "run",
        "wandb_name",
        "host",
        "data_variant",
        F.size("_steps").alias("phases"),
        joined(lambda s: s["run_id"]).alias("run_ids"),
        joined(lambda s: s["started"]).alias("started"),
        joined(lambda s: F.concat(F.lit(url), s["run_id"])).alias("urls"),
        F.concat(F.col("_gpu.gpu_count").cast("string"), F.lit("x "), F.col("_gpu.gpu")).alias("gpus"),
    )


def milestone_compare(milestone_rows: DataFrame, runs: list[str], metrics: tuple[str, ...] = ("val", "core", "cdpk")) -> DataFrame:
    """Runs side by side: one row per step, a column per run and metric, null where a run has none."""
    measures = [F.first(m).alias(m) for m in metrics]
    listed = milestone_rows.filter(F.col("run").isin(runs))
    return listed.groupBy("step").pivot("run", runs).agg(*measures)


