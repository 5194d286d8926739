from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarryline.operators import order, runs
from quarryline.sources import logs, sinks

LOG_A = """\
Auto-computed optimal batch size: 1,048,576 tokens
Total batch size 2,048 => gradient accumulation steps: 2
Using user-provided number of iterations: 5
Calculated number of iterations from target data:param ratio: 9,196
Calculated number of iterations from target data:param ratio: 7
Total number of training tokens: 9,642,704,896
Step 00000 | Validation bpb: 0.5
step 00001/09196 (0.01%) | loss: 10.3
 step 00777/09196 not at the line start
Step 00250 | Validation bpb: 0.946652
Evaluating: copa (0-shot, type: multiple_choice)... accuracy: 0.7000 | centered: 0.4000 | time: 1.2s
Evaluating: boolq (10-shot, type: multiple_choice)... accuracy: 0.5520 | centered: -0.1789 | time: 3.4s
Step 01000 | CORE metric: 0.1105
Step 01000 | CORE metric: 0.1106
Step 01000 | CDPK accuracy: 0.2803 (252/899)
Evaluating: lost (0-shot, type: schema)... accuracy: 0.1 | centered: 0.1
Step 01250 | Validation bpb: 0.8
step 01300/09196 (14%)
"""
LOG_B = """\
step 01200/09196
Evaluating: copa (0-shot, type: multiple_choice)... accuracy: 0.9 | centered: 0.8
Step 01000 | CORE metric: 0.3
Step 01250 | Validation bpb: 0.8
Step 02000 | CDPK accuracy: 0.2803 (252/899)
step 02000/09196
"""


def _write_runs(tmp_path):
    for run_dir, text, started in (("run-1-aa", LOG_A, "2026-02-17T20:46:50Z"), ("run-2-bb", LOG_B, "2026-02-18T01:00:00Z")):
        folder = tmp_path / "wandb" / run_dir / "files"
        folder.mkdir(parents=True)
        (folder / "output.log").write_text(text)
        (folder / "wandb-metadata.json").write_text(json.dumps({"gpu": f"G{run_dir[4]}", "gpu_count": 8, "startedAt": started, "extra": {}}))
    return str(tmp_path / "wandb")


@pytest.fixture
def phases(spark):
    specs = [("split run", "exp", ["aa", "bb"], "h", ["run-1-aa", "run-2-bb"], "all"), ("idle", "exp2", ["cc"], "h", ["run-3-cc"], "all")]
    return logs.run_phases(spark.createDataFrame(specs, logs.SPEC_SCHEMA))


@pytest.fixture
def events(spark, tmp_path, phases):
    return runs.parse_log(logs.run_log_scan(spark, _write_runs(tmp_path), phases)).cache()


def test_milestones(events):
    rows = {r["step"]: r for r in runs.milestones(events).collect()}
    assert set(rows) == {0, 250, 1000, 1250, 2000}
    assert (rows[1000]["core"], rows[1000]["cdpk"], rows[1000]["n"], rows[1000]["last_phase"]) == (0.3, 0.2803, 252, 1)
    assert rows[250]["val"] == 0.946652 and rows[250]["core"] is None
    assert {r["step"] for r in runs.visible(runs.milestones(events)).collect()} == {250, 1000, 1250, 2000}


def test_best_metrics_take_the_first_of_equals(events):
    row = runs.best_metrics(events).first()
    assert (row["best_val"], row["best_val_step"]) == (0.5, 0)
    assert (row["best_core"], row["best_core_step"]) == (0.3, 1000)
    assert (row["best_cdpk"], row["best_cdpk_step"], row["best_cdpk_n"]) == (0.2803, 1000, 252)


def test_config_and_latest_step(events):
    assert runs.run_config(events).first().asDict() == {
        "run": "split run", "planned_iterations": 9196, "planned_tokens": 9_642_704_896, "batch_size_tokens": 1_048_576,
    }
    assert runs.latest_step(events).first()["latest_step"] == 2000
    assert {r["phase_no"]: r["latest_step"] for r in runs.latest_step(events, ("run", "phase_no")).collect()} == {0: 1300, 1: 2000}
    no_steps = events.filter("kind <> 'step'")
    assert runs.latest_step(no_steps).first()["latest_step"] == 0


def test_task_blocks(events):
    tasks = runs.eval_task_blocks(events).orderBy("task_no").collect()
    # phase B's block for step 1000 holds the task left open by phase A, then its own
    assert [(r["step"], r["task_no"], r["task"], r["centered"]) for r in tasks] == [(1000, 0, "lost", 0.1), (1000, 1, "copa", 0.8)]


def test_core_line_without_tasks_keeps_the_earlier_block(events):
    first = runs.eval_task_blocks(events.filter("phase_no = 0")).orderBy("task_no").collect()
    assert [(r["step"], r["task"], r["shots"], r["type"]) for r in first] == [
        (1000, "copa", 0, "multiple_choice"), (1000, "boolq", 10, "multiple_choice"),
    ]


def _plain_blocks(rows):
    pending, blocks = [], {}
    for kind, step, task in rows:
        if kind == "task":
            pending.append(task)
        elif pending:
            blocks[step] = pending
            pending = []
    return blocks


@pytest.mark.parametrize("seed", range(4))
def test_task_blocks_do_not_depend_on_how_the_log_is_split(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [("core", rng.randrange(6), None) if rng.random() < 0.2 else ("task", None, f"t{i}") for i in range(150)]
    size = rng.choice([3, 10, 40])
    data = [("r", i // 100, i // size, i, k, s, t, 0, "x", 0.5, 0.5) for i, (k, s, t) in enumerate(rows)]
    schema = "run string, phase_no int, block int, seq bigint, kind string, step bigint, task string, shots bigint, type string, accuracy double, centered double"
    found: dict = {}
    for r in runs.eval_task_blocks(spark.createDataFrame(data, schema)).orderBy("step", "task_no").collect():
        assert r["task_no"] == len(found.setdefault(r["step"], []))
        found[r["step"]].append(r["task"])
    assert found == _plain_blocks(rows)


def test_latest_eval_and_check(spark, events):
    run_list = spark.createDataFrame([("split run",), ("idle",)], "run string")
    milestones = runs.milestones(events)
    rows = runs.latest_eval(runs.eval_task_blocks(events), milestones, run_list).collect()
    assert {(r["run"], r["task"], r["core"], r["has_tasks"]) for r in rows} == {
        ("split run", "lost", 0.3, True), ("split run", "copa", 0.3, True), ("idle", None, None, False),
    }
    check = runs.core_check(runs.eval_task_blocks(events), milestones).first()
    assert (check["mean_centered"], check["agrees"]) == (0.45, False)


def test_core_is_the_mean_of_centered_scores(spark):
    # The 22 task scores of one published evaluation and its logged CORE.
    centered = [
        0.3893, 0.0220, 0.2860, 0.6160, 0.2267, 0.4000, 0.0550, 0.4960, 0.1920, 0.3460, 0.3760,
        0.3553, 0.0640, 0.1160, 0.0326, 0.3760, 0.1571, 0.0000, 0.2040, 0.2100, -0.1789, 0.1837,
    ]
    tasks = spark.createDataFrame([("top50", 9196, c) for c in centered], "run string, step bigint, centered double")
    logged = spark.createDataFrame([("top50", 9196, 0.2239)], "run string, step bigint, core double")
    assert runs.core_check(tasks, logged).first()["agrees"] is True


def test_phase_labels(spark, events):
    phases = runs.latest_step(events, ("run", "phase_no"))
    rows = {r["step"]: r["phase"] for r in runs.attach_phase(runs.milestones(events), phases).collect()}
    assert rows == {0: "phase A", 250: "phase A", 1000: "phase A", 1250: "phase A", 2000: "phase B"}
    beyond = runs.attach_phase(spark.createDataFrame([("split run", 99_999)], "run string, step bigint"), phases)
    assert beyond.first()["phase"] == "phase B"
    single = runs.attach_phase(runs.milestones(events), phases.filter("phase_no = 0"))
    assert {r["phase"] for r in single.collect()} == {""}


def test_registry(spark, tmp_path, phases):
    metadata = logs.run_metadata_scan(spark, _write_runs(tmp_path))
    row = runs.run_registry(phases, metadata, "https://x/").filter("run = 'split run'").first()
    assert row["run_ids"] == "aa + bb"
    assert row["started"] == "2026-02-17 20:46:50 + 2026-02-18 01:00:00"
    assert row["urls"] == "https://x/aa + https://x/bb"
    assert row["gpus"] == "8x G2"


def test_large_log_keeps_line_order_over_splits(spark, tmp_path, phases):
    folder = tmp_path / "run-1-aa" / "files"
    folder.mkdir(parents=True)
    (folder / "output.log").write_text("".join(f"line {i}\n" for i in range(20_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = logs.run_log_scan(spark, str(tmp_path), phases)
        numbered = order.blocked_index(lines, ["run", "phase_no"], ["block"], ["seq"], "line_no")
        assert numbered.select("block").distinct().count() > 3
        assert numbered.filter(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("line")).count() == 0
        assert numbered.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_compare_has_a_column_per_run(spark, events):
    wide = runs.milestone_compare(runs.milestones(events), ["split run", "idle"])
    row = wide.filter("step = 250").first()
    assert (row["split run_val"], row["idle_val"]) == (0.946652, None)


def test_tracking_documents(spark, events, phases):
    run_list = phases.select("run").distinct()
    rows = {r["run"]: r for r in sinks.tracking_documents(runs.milestones(events), runs.eval_task_blocks(events), run_list).collect()}
    document = rows["split run"]
    assert (document["step"], document["core"], document["cdpk"]["d"]) == (1000, 0.3, 899)
    assert [t["task"] for t in document["tasks"]] == ["lost", "copa"]
    assert rows["idle"]["step"] is None
