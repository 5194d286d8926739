from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import order
from quarryline.sources import sinks

ORDER = ["-score", "id"]


def _table(spark, scores, parts=3):
    rows = [(i, s, i % 7) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "id bigint, score double, w bigint").repartition(parts)


def _expected(scores):
    def key(i):
        s = scores[i]
        if s is None:
            return (2, 0.0, i)
        return (0, 0.0, i) if math.isnan(s) else (1, -s, i)

    return sorted(range(len(scores)), key=key)


def _cases():
    rng = random.Random(5)
    mixed = [rng.choice([0.5, 0.5, 0.5, 1.0, -2.0, 0.0, -0.0, rng.random()]) for _ in range(500)]
    return {
        "mixed": mixed,
        "one_hot_value": [1.0] * 300,
        "third_hot": [3.0 if i % 3 == 0 else float(i) for i in range(400)],
        "nulls_and_nan": [None if i % 5 == 0 else float("nan") if i % 11 == 0 else float(i % 4) for i in range(200)],
        "infinite": [float("inf"), float("-inf"), float("nan"), None, 0.0, 1.0] * 20,
        "single": [0.25],
    }


@pytest.mark.parametrize("case", _cases())
@pytest.mark.parametrize("buckets", [1, 5, 16])
def test_global_rank_is_the_exact_order(spark, case, buckets):
    scores = _cases()[case]
    ranked = order.global_rank(_table(spark, scores), ORDER, buckets=buckets)
    got = [r["id"] for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
    assert got == _expected(scores)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(len(scores)))


def test_hot_value_spreads_over_buckets(spark):
    cut = order.split(_table(spark, [1.0] * 400), ORDER, buckets=8)
    assert len(cut.rows) == 8
    assert max(cut.rows) < 200


def test_many_buckets(spark):
    cut = order.split(spark.range(300_000), ["id"], buckets=9_000)
    assert (len(cut.rows), cut.total_rows) == (9_000, 300_000)
    last = order.top_rows(spark.range(300_000), ["id"], 123_456, cut).agg(F.max("id"), F.count("*")).first()
    assert tuple(last) == (123_455, 123_456)


def test_order_by_text_and_descending_integers(spark):
    rows = [(f"n{i % 13:02d}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "name string, n bigint")
    ranked = order.global_rank(df, ["name", "-n"], buckets=6).orderBy("rank").collect()
    assert [(r["name"], r["n"]) for r in ranked] == sorted(rows, key=lambda r: (r[0], -r[1]))
    with pytest.raises(TypeError):
        order.global_rank(df, ["-name", "n"])


@pytest.mark.parametrize("spec", ["n", "-n", "x", "-x"])
def test_nulls_sort_as_in_sql(spark, spec):
    rows = [(None if i % 4 == 0 else (i * 37) % 50 - 25, None if i % 5 == 0 else float(i % 6), i) for i in range(120)]
    df = spark.createDataFrame(rows, "n bigint, x double, id bigint").repartition(3)
    expected = [r["id"] for r in order.sort_by(df, [spec, "id"]).collect()]
    ranked = order.global_rank(df, [spec, "id"], buckets=7).collect()
    assert [r["id"] for r in sorted(ranked, key=lambda r: r["rank"])] == expected
    cut = order.split(df, [spec, "id"], buckets=7)
    for count in (1, 20, 31, 60, 95, 119):
        assert {r["id"] for r in order.top_rows(df, [spec, "id"], count, cut).collect()} == set(expected[:count])


def test_prefix_filters_reach_the_scan(spark, tmp_path):
    _table(spark, [float(i) for i in range(100)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert "GreaterThanOrEqual(score,90.0)" in order.top_rows(df, ORDER, 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,9)" in order.top_rows(df, ["id"], 10)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("count", [0, 1, 37, 199, 200, 500])
def test_top_rows(spark, count):
    scores = [float(i % 9) for i in range(200)]
    df = _table(spark, scores)
    for buckets in (None, 6):
        cut = order.split(df, ORDER, buckets=buckets)
        assert {r["id"] for r in order.top_rows(df, ORDER, count, cut).collect()} == set(_expected(scores)[:count])


@pytest.mark.parametrize("budget", [0, 1, 5, 100, 333, 599, 600, 601, 10_000])
def test_budget_rows_is_the_shortest_covering_prefix(spark, budget):
    scores = [float(i % 9) for i in range(200)]
    weights = [i % 7 for i in range(200)]
    df = _table(spark, scores)
    cut = order.split(df, ORDER, weight="w", buckets=6)
    kept = {r["id"] for r in order.budget_rows(df, ORDER, "w", budget, cut).collect()}
    assert kept == {r["id"] for r in order.budget_rows(df, ORDER, "w", budget).collect()}
    total, expected = 0, set()
    for i in _expected(scores):
        if total >= budget:
            break
        expected.add(i)
        total += weights[i]
    # rows of weight zero straight after the budget is met are not part of the shortest prefix
    assert kept == expected


def test_running_total(spark):
    scores = [float(i % 9) for i in range(120)]
    df = _table(spark, scores)
    cut = order.split(df, ORDER, weight="w", buckets=5)
    got = {r["id"]: r["total_before"] for r in order.running_total(df, ORDER, "w", cut=cut).collect()}
    total = 0
    for i in _expected(scores):
        assert got[i] == total
        total += i % 7


@pytest.mark.parametrize(("rows", "percent", "kept"), [(1000, 16.5, 165), (1001, 16.5, 166), (3, 1, 1), (10, 100, 10), (1, 0.001, 1)])
def test_top_percent_count(rows, percent, kept):
    assert order.top_percent_count(rows, percent) == kept


def test_top_percent_rejects_bad_input(spark):
    for percent in (0, -1, 100.5):
        with pytest.raises(ValueError):
            order.top_percent_count(10, percent)
    with pytest.raises(ValueError):
        order.top_percent(_table(spark, []), ORDER, 10)


def test_thresholds(spark):
    found = {r["threshold"]: (r["rank"], r["value"]) for r in order.rank_thresholds(_table(spark, [float(i) for i in range(40)]), ORDER, "score").collect()}
    assert found == {"top_10_percent": (4, 35.0), "top_25_percent": (10, 29.0), "median": (20, 19.0)}


@pytest.mark.parametrize(("rows", "per_shard", "per_task"), [(100, 7, 14), (98, 7, 21), (5, 10, 10), (60, 1, 4)])
def test_shards_hold_exact_runs_of_the_order(spark, tmp_path, rows, per_shard, per_task):
    scores = [2.0 if i % 3 == 0 else float(i % 5) for i in range(rows)]
    sinks.write_sharded(_table(spark, scores), str(tmp_path / "out"), ORDER, per_shard, rows_per_task=per_task)
    back = sinks.read_shards(spark, str(tmp_path / "out")).collect()
    got = [r["id"] for r in sorted(back, key=lambda r: (r["shard_id"], r["row_in_shard"]))]
    assert got == _expected(scores)
    sizes = [sum(r["shard_id"] == s for r in back) for s in range(math.ceil(rows / per_shard))]
    assert sizes == [per_shard] * (rows // per_shard) + ([rows % per_shard] if rows % per_shard else [])
    files = sorted(f.name for f in (tmp_path / "out").glob("version-*/*.parquet"))
    assert files == [f"shard_{s:05d}.parquet" for s in range(len(sizes))]


def test_rows_lie_in_order_inside_a_shard_file(spark, tmp_path):
    version = sinks.write_sharded(_table(spark, [float(i % 11) for i in range(90)]), str(tmp_path / "o"), ORDER, 30, rows_per_task=60)
    for shard in range(3):
        one = spark.read.parquet(f"{version}/shard_{shard:05d}.parquet").select("id", "score", F.col("_metadata.row_index").alias("i")).orderBy("i").collect()
        assert [r["id"] for r in one] == _expected([float(i % 11) for i in range(90)])[30 * shard : 30 * shard + 30]


def test_publish_keeps_earlier_versions(spark, tmp_path):
    path = str(tmp_path / "out")
    first = sinks.write_sharded(_table(spark, [1.0, 2.0]), path, ORDER, 1)
    second = sinks.write_sharded(_table(spark, [1.0, 2.0, 3.0]), path, ORDER, 1)
    assert sinks.current_version(spark, path) == second
    assert spark.read.parquet(first).count() == 2


def test_top_rows_does_not_shuffle_the_table(spark):
    plan = order.top_rows(_table(spark, [float(i) for i in range(50)], parts=1), ORDER, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan
    assert "Sort" not in plan


def test_shards_are_dealt_over_all_slots_and_read_in_turn(spark, tmp_path):
    rows = _table(spark, [float(i % 11) for i in range(2_500)])
    assert sinks.with_shards(rows, ORDER, 100).rdd.getNumPartitions() == 4  # the slots of the session
    version = sinks.write_sharded(rows, str(tmp_path / "o"), ORDER, 1)  # more than 999 files in a task would be, in order of their names, out of turn
    found = sinks.read_shards(spark, str(tmp_path / "o")).orderBy("shard_id").select("score", "row_in_shard").collect()
    assert [r["score"] for r in found] == sorted((float(i % 11) for i in range(2_500)), reverse=True) and not any(r["row_in_shard"] for r in found)
    assert sinks._task_and_file("file:/x/part-00002-a-c1000.zstd.parquet") > sinks._task_and_file("file:/x/part-00002-a-c999.zstd.parquet") and version
