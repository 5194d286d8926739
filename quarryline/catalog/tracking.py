"""Training-run queries over log lines derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.catalog.tables import EVENTS_SQL, run_lines
from quarryline.operators import order, runs
from quarryline.session import new_folder, stage
from quarryline.sources import logs, sinks

RUNS = ["run0", "run1", "run2", "run3"]
URL = "https://tracker.example/runs/"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.parse_log(run_lines(spark, sf_dir))


def _staged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed log as a written table, for jobs that read it more than once."""
    return stage(_events(spark, sf_dir), "events")


def _run_list(spark: SparkSession) -> DataFrame:
    """The runs of the logs and one that never logged."""
    return spark.createDataFrame([(name,) for name in [*RUNS, "run9"]], "run string")


def run_phases(spark: SparkSession) -> DataFrame:
    specs = [(name, f"edu-{name}", [f"{name}x{i}" for i in range(3)], "host-a", [f"{name}-{i}" for i in range(3)], "filtered") for name in RUNS]
    return logs.run_phases(spark.createDataFrame(specs, logs.SPEC_SCHEMA))


def run_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "logs")
    lines = run_lines(spark, sf_dir).withColumn("folder", F.concat_ws("-", "run", F.col("phase_no").cast("string")))
    (
        lines.repartitionByRange("folder", "seq")  # as many files as the lines need, in order
        .sortWithinPartitions("folder", "seq")
        .select("folder", "line")
        .write.partitionBy("folder")
        .text(path)
    )
    scanned = logs.run_log_scan(spark, path, run_phases(spark), "*.txt", r"folder=([^/]+)/")
    numbered = order.blocked_index(scanned, ["run", "phase_no"], ["block"], ["seq"], "line_no")
    return numbered.select("run", "phase_no", "line_no", "line")


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("run", "phase_no", "seq", "kind", "step", "value", "task", "shots", "accuracy", "centered")


def latest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest_step(_events(spark, sf_dir), ("run", "phase_no"))


def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.visible(runs.milestones(_events(spark, sf_dir)))


def best_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_metrics(_events(spark, sf_dir))


def run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_config(_events(spark, sf_dir))


def eval_task_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.eval_task_blocks(_staged_events(spark, sf_dir)).drop("type")


def latest_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _staged_events(spark, sf_dir)
    return runs.latest_eval(stage(runs.eval_task_blocks(events), "tasks"), runs.milestones(events), _run_list(spark)).drop("type")


def core_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _staged_events(spark, sf_dir)
    return runs.core_check(runs.eval_task_blocks(events), runs.milestones(events), 0.05)


def attach_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _staged_events(spark, sf_dir)
    phases = runs.latest_step(events, ("run", "phase_no"))
    return runs.attach_phase(runs.milestones(events), phases).select("run", "step", "last_phase", "phase")


def run_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = run_lines(spark, sf_dir).select("run", "phase_no", F.col("seq").alias("event_id"))
    metadata = (
        lines.join(events.select("event_id", "ts"), "event_id")
        .groupBy(F.concat_ws("-", "run", F.col("phase_no").cast("string")).alias("run_dir"))
        .agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("startedAt"), (F.count("*") % 8 + 1).cast("int").alias("gpu_count"))
        .withColumn("gpu", F.lit("H100"))
    )
    return runs.run_registry(run_phases(spark), metadata, URL)


def milestone_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.milestone_compare(runs.milestones(_events(spark, sf_dir)), RUNS)


def tracking_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _staged_events(spark, sf_dir)
    documents = sinks.tracking_documents(runs.milestones(events), runs.eval_task_blocks(events), _run_list(spark))
    path = new_folder(spark, "tracking")
    documents.write.json(path)
    schema = "run string, step bigint, core double, val_bpb double, cdpk struct<acc double, n bigint, d bigint>, tasks array<struct<task string, centered double>>"
    back = spark.read.schema(schema).json(path)
    return back.select(
        "run", "step", "core", "val_bpb", F.col("cdpk.acc").alias("cdpk"), F.coalesce(F.size("tasks"), F.lit(0)).cast("bigint").alias("tasks"),
        F.get("tasks", F.lit(0))["task"].alias("first_task"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        run_log_scan, parsed_events, latest_step, milestones, best_metrics, run_config, eval_task_blocks, latest_eval,
        core_check, attach_phase, run_registry, milestone_compare, tracking_documents,
    )
}


def _dec(factor: int, digits: int) -> str:
    return f"'0.' || lpad((event_id * {factor} % {10**digits})::VARCHAR, {digits}, '0')"


_LINES = f"""
t AS (
  SELECT *, 'run' || (user_id % 4)::VARCHAR AS run, lpad((250 * (event_id % 20 + 10 * phase_no))::VARCHAR, 5, '0') AS s
  FROM (SELECT *, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS phase_no FROM events)),
lines AS (
  SELECT run, phase_no, event_id, CASE event_type
    WHEN 'view' THEN 'step ' || s || '/10000 | loss: ' || {_dec(31, 3)}
    WHEN 'click' THEN 'Step ' || s || ' | Validation bpb: ' || {_dec(7919, 6)}
    WHEN 'purchase' THEN 'Step ' || s || ' | CORE metric: ' || {_dec(104729, 4)}
    WHEN 'error' THEN 'Step ' || s || ' | CDPK accuracy: ' || {_dec(1299709, 4)} || ' (' || (event_id % 899)::VARCHAR || '/899)'
    ELSE CASE WHEN event_id % 4 = 0 THEN [
        'Calculated number of iterations from target data:param ratio: ' || format('{{:,}}', event_id),
        'Using user-provided number of iterations: ' || format('{{:,}}', event_id),
        'Total number of training tokens: ' || format('{{:,}}', event_id * 524288),
        'Total batch size ' || format('{{:,}}', event_id * 1024) || ' => gradient accumulation steps: 4'][(event_id // 4) % 4 + 1]
      ELSE 'Evaluating: task_' || (event_id % 22)::VARCHAR || ' (' || (event_id % 11)::VARCHAR || '-shot, type: multiple_choice)... accuracy: '
        || {_dec(15485863, 4)} || ' | centered: ' || CASE WHEN event_id % 5 = 0 THEN '-' ELSE '' END || {_dec(32452843, 4)} || ' | time: 1.2s' END END AS line
  FROM t)"""

_FIRST = "arg_min({v}, pos) FILTER (kind = '{k}')"

ORACLE = {
    "run_log_scan": f"WITH {_LINES} SELECT run, phase_no, row_number() OVER (PARTITION BY run, phase_no ORDER BY event_id) - 1 AS line_no, line FROM lines",
    "parsed_events": f"""
      WITH {EVENTS_SQL} SELECT run, phase_no, pos AS seq, kind,
        CASE WHEN kind IN ('step', 'val', 'core', 'cdpk') THEN step END AS step, value,
        CASE WHEN kind = 'task' THEN 'task_' || (pos % 22)::VARCHAR END AS task, CASE WHEN kind = 'task' THEN pos % 11 END AS shots,
        CASE WHEN kind = 'task' THEN accuracy END AS accuracy, CASE WHEN kind = 'task' THEN centered END AS centered FROM ev""",
    "latest_step": f"WITH {EVENTS_SQL} SELECT run, phase_no, coalesce(max(step) FILTER (kind = 'step'), 0)::BIGINT AS latest_step FROM ev GROUP BY run, phase_no",
    "milestones": f"WITH {EVENTS_SQL} SELECT run, step, val, core, cdpk, n, d::BIGINT AS d, last_phase FROM ms WHERE step > 0",
    "best_metrics": f"""
      WITH {EVENTS_SQL}, r AS (
        SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY CASE WHEN kind = 'val' THEN value ELSE -value END, pos) AS best FROM ev WHERE kind IN ('val', 'core', 'cdpk'))
      SELECT run, max(value) FILTER (kind = 'val') AS best_val, max(step) FILTER (kind = 'val') AS best_val_step,
        max(value) FILTER (kind = 'core') AS best_core, max(step) FILTER (kind = 'core') AS best_core_step,
        max(value) FILTER (kind = 'cdpk') AS best_cdpk, max(step) FILTER (kind = 'cdpk') AS best_cdpk_step,
        max(n) FILTER (kind = 'cdpk') AS best_cdpk_n, max(899::BIGINT) FILTER (kind = 'cdpk') AS best_cdpk_d
      FROM r WHERE best = 1 GROUP BY run""",
    "run_config": f"""
      WITH {EVENTS_SQL} SELECT run,
        coalesce({_FIRST.format(v='pos', k='iterations_auto')}, {_FIRST.format(v='pos', k='iterations_fixed')}) AS planned_iterations,
        {_FIRST.format(v='pos * 524288', k='tokens')} AS planned_tokens, {_FIRST.format(v='pos * 1024', k='batch_total')} AS batch_size_tokens
      FROM ev GROUP BY run""",
    "eval_task_blocks": f"WITH {EVENTS_SQL} SELECT * FROM tasks",
    "latest_eval": f"""
      WITH {EVENTS_SQL}, last AS (SELECT run, max(step) AS step FROM tasks GROUP BY run)
      SELECT r.run, l.step, m.core, t.task_no, t.task, t.shots, t.accuracy, t.centered, t.task IS NOT NULL AS has_tasks
      FROM (SELECT unnest(['run0', 'run1', 'run2', 'run3', 'run9']) AS run) r LEFT JOIN last l USING (run)
      LEFT JOIN ms m ON m.run = l.run AND m.step = l.step LEFT JOIN tasks t ON t.run = l.run AND t.step = l.step""",
    "core_check": f"""
      WITH {EVENTS_SQL} SELECT run, step, count(*) AS tasks, any_value(core) AS core, round(avg(centered), 6) AS mean_centered,
        abs(any_value(core) - avg(centered)) < 0.05::DOUBLE AS agrees FROM tasks JOIN ms USING (run, step) WHERE core IS NOT NULL GROUP BY run, step""",
    "attach_phase": f"""
      WITH {EVENTS_SQL}, ends AS (SELECT run, phase_no, coalesce(max(step) FILTER (kind = 'step'), 0) AS last FROM ev GROUP BY run, phase_no)
      SELECT m.run, m.step, any_value(m.last_phase) AS last_phase,
        'phase ' || chr((65 + coalesce(min(e.phase_no) FILTER (m.step <= e.last), max(e.phase_no)))::INTEGER) AS phase
      FROM ms m JOIN ends e USING (run) GROUP BY m.run, m.step""",
    "run_registry": f"""
      WITH {EVENTS_SQL}, m AS (
        SELECT 'run' || (user_id % 4)::VARCHAR AS run, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS phase_no,
          strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, count(*) % 8 + 1 AS gpus FROM events GROUP BY ALL)
      SELECT run, 'edu-' || run AS wandb_name, 'host-a' AS host, 'filtered' AS data_variant, 3::INTEGER AS phases,
        run || 'x0 + ' || run || 'x1 + ' || run || 'x2' AS run_ids, string_agg(started, ' + ' ORDER BY phase_no) AS started,
        '{URL}' || run || 'x0 + {URL}' || run || 'x1 + {URL}' || run || 'x2' AS urls, arg_max(gpus, phase_no)::VARCHAR || 'x H100' AS gpus
      FROM m GROUP BY run""",
    "milestone_compare": f"WITH {EVENTS_SQL} SELECT step, "
    + ", ".join(f"max({m}) FILTER (run = '{r}') AS {r}_{m}" for r in RUNS for m in ("val", "core", "cdpk"))
    + " FROM ms GROUP BY step",
    "tracking_documents": f"""
      WITH {EVENTS_SQL}, per AS (SELECT run, step, count(*) AS tasks, arg_min(task, task_no) AS first_task FROM tasks GROUP BY run, step)
      SELECT r.run, p.step, m.core, m.val AS val_bpb, m.cdpk, coalesce(p.tasks, 0) AS tasks, p.first_task
      FROM (SELECT unnest(['run0', 'run1', 'run2', 'run3', 'run9']) AS run) r LEFT JOIN per p USING (run)
      LEFT JOIN ms m ON m.run = p.run AND m.step = p.step""",
}
