"""JSON lists of many forms, split at every few bytes, beside the json module."""

from __future__ import annotations

import json
import random

import pytest

from quarryline.sources import benchmarks
from quarryline.sources.json_lists import json_list_records

ODD = ['}', '{', '"', "\\", '"}', '\\"', "[", "]", "é😀", "\n", '"examples": [', "a}b{c]d[", "", '{"data": [{']


def _items(r, count):
    nested = lambda: r.choice([None, 1.5, True, r.choice(ODD), [r.choice(ODD), {"x": r.choice(ODD)}], {"k": [1, {"l": r.choice(ODD)}]}, {}, []])
    return [{"id": f"q{i}{r.choice(ODD)}", "n": i, **{f"f{j}": nested() for j in range(r.randint(0, 4))}} for i in range(count)]


def _forms(r):
    for count in (1, 9):
        rows = _items(r, count)
        for indent in (None, 1):
            dump = lambda x, indent=indent, ascii=r.random() < 0.5: json.dumps(x, indent=indent, ensure_ascii=ascii)
            other = {"meta": {"examples": [{"no": 1}]}, "tags": ["}", "x"], "note": "a}b\"c"}
            yield rows, dump(rows)
            yield rows, "﻿ \n" + dump([1, "x{}", *rows]) + "\n"
            yield rows, dump({"examples": rows})
            yield rows, dump({**other, "data": rows, "after": [{"no": 2}], "last": {"data": [{"no": 3}]}})
            yield rows, dump({"data": [{"no": 4}, {"no": 5}], **other, "examples": rows, "size": count})


def test_every_form_split_everywhere(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    expected = {}
    for i, (rows, text) in enumerate(_forms(random.Random(5))):
        (tmp_path / f"f{i}.json").write_text(text, encoding="utf-8")
        expected[f"f{i}.json"] = rows
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "none.json").write_text('{"other": [{"a": 1}], "examples": []}')
    try:
        for size in ("250b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found: dict[str, dict[int, dict]] = {}
            for x in json_list_records(spark, str(tmp_path)).collect():
                found.setdefault(x["_file"].rsplit("/", 1)[1], {})[x["source_row"]] = json.loads(x["record"])
            assert set(found) == set(expected)
            for name, rows in expected.items():
                assert [found[name][k] for k in sorted(found[name])] == rows and sorted(found[name]) == list(range(len(rows)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rows = [{"id": f"q{i}", "question": f"what {i}"} for i in range(400)]
    (tmp_path / "big.json").write_text(json.dumps({"examples": rows}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "big.json")).rdd.getNumPartitions() > 5
        found = benchmarks.mcq_scan(spark, str(tmp_path / "big.json")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    assert sorted((x["source_row"], x["id"], x["question"], x["file_stem"]) for x in found) == [(i, f"q{i}", f"what {i}", "big") for i in range(400)]
    (tmp_path / "bare.json").write_text("[]")
    with pytest.raises(ValueError, match="no rows"):
        benchmarks.mcq_scan(spark, str(tmp_path / "bare.json"))
