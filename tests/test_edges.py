"""Inputs that once lost or doubled rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarryline.operators import runs, sampling
from quarryline.plans import curate
from quarryline.sources import corpus, files, sinks


def _write(spark, folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    spark.range(rows).toPandas().to_parquet(folder / name)


def test_prefix_is_matched_against_the_path_below_the_root(spark, tmp_path):
    _write(spark, tmp_path / "docs_a", "one.parquet", 1)
    _write(spark, tmp_path / "other", "docs_z.parquet", 2)
    _write(spark, tmp_path, "docs_root.parquet", 4)
    assert corpus.scan_corpus(spark, str(tmp_path), "docs").count() == 5
    assert corpus.scan_corpus(spark, str(tmp_path), "docs", num_files=1).count() == 1
    with pytest.raises(FileNotFoundError):
        corpus.scan_corpus(spark, str(tmp_path), "none")


def test_audit_reads_names_with_blanks_percent_signs_and_plus_signs(spark, tmp_path):
    for name in ("a b.parquet", "x%y.parquet", "p+q.parquet", "r[1].parquet"):
        _write(spark, tmp_path, name, 5)
    found = files.empty_file_audit(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["rows"], r["is_empty"]) for r in found) == [
        ("a b.parquet", 5, False), ("p+q.parquet", 5, False), ("r[1].parquet", 5, False), ("x%y.parquet", 5, False),
    ]
    assert corpus.scan_corpus(spark, str(tmp_path), "r[").count() == 5


def test_configs_with_different_text_columns_all_count(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("text")).write.parquet(str(tmp_path / "a"))
    spark.range(10).select(F.col("id").cast("string").alias("content")).write.parquet(str(tmp_path / "b"))
    out = str(tmp_path / "out")
    curate.random_subset(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}, out, ratio=1.0)
    assert corpus.scan_corpus(spark, sinks.current_version(spark, out)).count() == 20


def test_budget_counts_the_current_version_only(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("text"), F.col("id").alias("token_count")).write.parquet(str(tmp_path / "a"))
    out = str(tmp_path / "out")
    for _ in range(2):
        curate.random_subset(spark, {"a": str(tmp_path / "a")}, out, ratio=1.0)
    row = curate.subset_budget(spark, out).first()
    assert 45 in row.asDict().values() and 90 not in row.asDict().values()


@pytest.mark.parametrize("percent", [0, -1, 150, float("nan")])
def test_a_share_that_is_none_is_refused(spark, tmp_path, percent):
    with pytest.raises(ValueError):
        curate.curate(spark, str(tmp_path), str(tmp_path / "out"), top_percent=percent)


def test_null_config_is_not_the_total(spark):
    rows = spark.createDataFrame([(None, "x"), ("c", "y")], "config string, text string")
    report = sampling.sampling_report(rows, F.col("text"), 1.0, 10).collect()
    assert sorted((str(r["config"]), r["seen"]) for r in report) == [("(all)", 2), ("None", 1), ("c", 1)]


def test_phase_letter_follows_the_phase_number(spark):
    ends = spark.createDataFrame([("r", 0, 0), ("r", 1, 10)], "run string, phase_no int, latest_step long")
    rows = spark.createDataFrame([("r", 5)], "run string, step long")
    assert runs.attach_phase(rows, ends).first()["phase"] == "phase B"
    late = ends.where("phase_no = 1").unionByName(ends.where("phase_no = 1").withColumn("phase_no", F.lit(2)))
    assert runs.attach_phase(rows, late).first()["phase"] == "phase B"


def test_all_tasks_of_an_evaluation_are_one_document(spark):
    tasks = spark.range(2_500).selectExpr(
        "'r' AS run", "1L AS step", "id AS task_no", "'t' AS task", "0 AS shots", "'x' AS type", "0.5 AS accuracy", "0.1 AS centered"
    )
    milestones = spark.createDataFrame([("r", 1, 0.1, 0.2, 0.3, 1, 2)], "run string, step long, core double, val double, cdpk double, n long, d long")
    listed = spark.createDataFrame([("r", "h")], "run string, host string")
    found = sinks.tracking_documents(milestones, tasks, listed).collect()
    assert len(found) == 1 and len(found[0]["tasks"]) == 2_500 and found[0]["host"] == "h"
