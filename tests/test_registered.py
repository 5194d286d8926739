"""Every registered query gives the rows of its SQL, and its plan has no whole-table bottleneck."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry
from quarryline.catalog import oracle_sql, queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 33


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if "ArrowEvalPython" in plan:
        assert name == "hash_sample_blake2b"
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert "], [" in line, "a window without partitions sorts the table in one task"
    if name in ORACLE:
        assert differences(df, duck, ORACLE[name]) == []
    else:
        assert df.count() > 0
