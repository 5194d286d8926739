"""Run registered queries beside their SQL and compare rows.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import tempfile
import time
import traceback
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def _duck_type(name: str) -> str:
    return {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}.get(name, name)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark result and its SQL: columns, types, rows."""
    found = [tuple(row) for row in df.collect()]
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: _duck_type(str(d[1])) for d in result.description}
    expected = result.fetchall()
    problems = []
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    for name, dtype in df.dtypes:
        if dtype.replace("timestamp_ntz", "timestamp") != types[name]:
            problems.append(f"type of {name}: {dtype} != {types[name]}")
    if len(found) != len(expected):
        problems.append(f"rows {len(found)} != {len(expected)}")
    ours, theirs = _bag(df.columns, found), _bag(columns, expected)
    if ours != theirs:
        problems.append(f"{sorted(columns)}: only here {list((ours - theirs).items())[:3]} only SQL {list((theirs - ours).items())[:3]}")
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from quarryline.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quarryline-compare-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if args.names and name not in args.names:
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                problems = differences(df, con, oracle[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception:
            problems = [traceback.format_exc()[-1500:]]
        failed += bool(problems)
        kind = "sql" if name in oracle else "rows"
        print(f"{'ok  ' if not problems else 'FAIL'} {name} [{kind}] {time.time() - started:.2f}s {' | '.join(problems)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
