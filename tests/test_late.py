"""Text meets a choice at its scan, and sketches keep their bound."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.operators import late, order
from quarryline.session import stage


@pytest.fixture
def tables(spark):
    keys = stage(spark.range(3_000).select("id", (F.col("id") * 7919 % 97).alias("score")), "keys")
    return keys, stage(spark.range(3_100).select("id", F.md5(F.col("id").cast("string")).alias("text")), "wide")


def test_large_choice_filters_the_text_scan_before_any_exchange(spark, tables):
    keys, wide = tables
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        chosen = order.top_percent(keys, ["-score", "id"], 10)
        found = late.attach(chosen, wide, "id", small=False)
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        rows = found.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    text = next(i for i, line in enumerate(plan) if re.search(r"Relation \[id#\d+L,text#", line))
    depth = plan[text].index("+-")
    assert any("might_contain" in line and line.find("Filter") < depth + 4 for line in plan[:text]) and rows == 300


def test_small_choice_moves_no_text(spark, tables):
    keys, wide = tables
    found = late.attach(order.top_percent(keys, ["-score", "id"], 10), wide, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    exact = sorted((r["score"], -r["id"]) for r in keys.collect())[-300:]
    assert sorted((r["score"], -r["id"]) for r in found.collect()) == exact


@pytest.mark.parametrize("k", [50, 800])
def test_sketched_thresholds_lie_within_their_bound(spark, k):
    r = random.Random(k)
    values = [r.choice([r.random(), 0.5, r.gauss(0, 9)]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(7)
    found = {x["threshold"]: x for x in order.rank_thresholds_sketched(df, "v", k).collect()}
    assert set(found) == {"top_10_percent", "top_25_percent", "median"}
    for name, part in (("top_10_percent", 10), ("top_25_percent", 4), ("median", 2)):
        row = found[name]
        above, at_least = sum(v > row["value"] for v in values), sum(v >= row["value"] for v in values)
        assert row["rank"] == 20_000 // part and above - row["error_rows"] <= row["rank"] <= at_least + row["error_rows"]
    assert found["median"]["error_rows"] < (1_600 if k == 50 else 130)
    assert order.rank_thresholds_sketched(df.limit(0), "v", k).count() == 0
