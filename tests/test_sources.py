from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarryline.operators import sampling
from quarryline.operators.lookup import fits_broadcast, lookup
from quarryline.session import stage
from quarryline.sources import corpus, files, listing


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, df):
        target = tmp_path / "in" / name
        df.coalesce(1).write.parquet(str(tmp_path / "parts" / name))
        part = next((tmp_path / "parts" / name).glob("*.parquet"))
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(part.read_bytes())

    write("b.parquet", spark.createDataFrame([("b0", 1), ("b1", 2)], "text string, quality int"))
    write("a.parquet", spark.createDataFrame([("a0", [1.0])], "text string, embedding array<float>"))
    write("sub/c.parquet", spark.createDataFrame([], "text string, quality int"))
    (tmp_path / "in" / "notes.txt").write_text("not data")
    return str(tmp_path / "in")


def test_scan_merges_schemas_and_ignores_other_files(spark, folder):
    rows = corpus.scan_corpus(spark, folder)
    assert set(rows.columns) == {"text", "quality", "embedding"}
    assert {r["text"]: r["quality"] for r in rows.collect()} == {"a0": None, "b0": 1, "b1": 2}
    assert corpus.scan_corpus(spark, folder, prefix="b").count() == 2
    assert [r["text"] for r in corpus.scan_corpus(spark, folder, num_files=1).collect()] == ["a0"]
    assert corpus.scan_corpus(spark, folder, prefix="sub/c").count() == 0
    with pytest.raises(FileNotFoundError):
        corpus.scan_corpus(spark, folder, prefix="z", num_files=1)


def test_dropped_columns_are_not_read(spark, folder):
    plan = corpus.drop_heavy_columns(corpus.scan_corpus(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan
    assert corpus.drop_heavy_columns(spark.range(1)).columns == ["id"]


def test_width_saved(spark):
    df = spark.createDataFrame([("é", [1.0, 2.0]), (None, None)], "text string, embedding array<float>")
    assert tuple(corpus.width_saved(df).first()) == (2, 8, 80.0)


def test_union_widens_types(spark):
    frames = [spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(2**40, "x")], "n bigint, t string")]
    merged = corpus.union_by_name(frames)
    assert merged.schema["n"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, merged.collect())) == [(1, None), (2**40, "x")]


def test_configs_keep_their_row_numbers(spark, folder):
    rows = corpus.multi_config_scan(spark, {"x": f"{folder}/a.parquet", "y": f"{folder}/b.parquet"})
    assert {(r["config"], r["source_row"], r["text"]) for r in rows.collect()} == {("x", 0, "a0"), ("y", 0, "b0"), ("y", 1, "b1")}


def test_positions_run_through_all_files_of_a_config(spark, tmp_path):
    for name, rows in (("b%20+b.parquet", 5), ("a.parquet", 3), ("c.parquet", 0), ("d.parquet", 4)):
        (tmp_path / "x").mkdir(exist_ok=True)
        spark.range(rows).selectExpr(f"'{name[0]}' || id AS text").toPandas().astype({"text": "string"}).to_parquet(tmp_path / "x" / name)
    spark.range(2).selectExpr("'y' || id AS text").write.parquet(str(tmp_path / "y"))
    rows = corpus.multi_config_scan(spark, {"x": str(tmp_path / "x"), "y": str(tmp_path / "y")})
    found = sorted((r["config"], r["source_row"], r["text"]) for r in rows.collect())
    expected = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(5)] + [f"d{i}" for i in range(4)]
    assert [f[2] for f in found if f[0] == "x"] == expected and [f[1] for f in found if f[0] == "x"] == list(range(12))
    keys = [r[0] for r in rows.select(sampling.row_key(rows)).collect()]
    assert len(set(keys)) == 14 and "x:3:b0" in keys
    assert corpus.dataset_configs(spark, str(tmp_path)) == {"x": f"file:{tmp_path}/x", "y": f"file:{tmp_path}/y"}
    assert list(corpus.dataset_configs(spark, str(tmp_path / "x"))) == ["x"]


def test_first_files_are_chosen_before_they_are_read(spark, tmp_path):
    for i in range(8):
        spark.range(10).toPandas().to_parquet(tmp_path / f"f{i} +%.parquet")
    rows = corpus.scan_corpus(spark, str(tmp_path), num_files=3)
    plan = rows._jdf.queryExecution().executedPlan()
    assert rows.count() == 30 and plan.toString().count(".parquet") <= 2
    plan.executeCollect()
    leaves = plan.collectLeaves()
    assert [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())] == [3]


def test_listing_by_executors_equals_the_manifest(spark, folder, tmp_path):
    (tmp_path / "in" / "sub" / "deep").mkdir()
    (tmp_path / "in" / "sub" / "deep" / "d e.parquet").write_text("x" * 9)
    (tmp_path / "in" / "_hidden").mkdir()
    (tmp_path / "in" / "_hidden" / "h.parquet").write_text("x")
    for pattern in ("*", "*.parquet"):
        ours = {(r["name"], r["length"]) for r in listing.list_files(spark, f"file://{folder}", pattern).collect()}
        assert ours == {(r["name"], r["length"]) for r in files.file_manifest(spark, folder, pattern).collect()}
    found = listing.with_prefix(listing.list_files(spark, folder), folder, "sub/d")
    assert [(r["name"], r["length"]) for r in found.collect()] == [("d e.parquet", 9)]
    assert "d e.parquet" not in found._jdf.queryExecution().executedPlan().toString()


def test_manifest_and_audit(spark, folder):
    listing = files.file_manifest(spark, folder)
    assert {r["name"] for r in listing.collect()} == {"a.parquet", "b.parquet", "c.parquet", "notes.txt"}
    assert files.manifest_summary(listing).first()["files"] == 4
    empty = files.manifest_summary(listing.limit(0)).first()
    assert (empty["files"], empty["bytes"], empty["gib"]) == (0, 0, 0.0)
    audit = {r["name"]: (r["rows"], r["is_empty"]) for r in files.empty_file_audit(spark, folder).collect()}
    assert audit == {"a.parquet": (1, False), "b.parquet": (2, False), "c.parquet": (0, True)}


def test_pointer_files(spark, tmp_path):
    digest = "0123456789abcdef0123456789abcdef"
    (tmp_path / "a.dvc").write_text(f"outs:\n- md5: {digest}\n  path: data file.csv \n")
    (tmp_path / "b.dvc").write_text("outs:\n- path: x.csv\n")
    store = spark.createDataFrame([(f"01/{digest[2:]}", 5)], "object_key string, length bigint")
    row = files.pointer_manifest(files.read_pointer_files(spark, str(tmp_path)), store).collect()
    assert len(row) == 1
    assert (row[0]["md5"], row[0]["target"], row[0]["status"]) == (digest, "data file.csv", "present")


def test_lookup_is_a_left_join_and_splits_a_hot_key(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, v int")
    found = lookup(left, right, ["k"])
    assert found.count() == 1000
    assert found.filter("k = 'hot' and v = 1").count() == 334
    assert found.filter("v is null").count() == 1000 - 334 - 1


def test_broadcast_size_check(spark):
    assert fits_broadcast(spark.createDataFrame([("a", None)], "p string, t string"), ["p", "t"])
    assert not fits_broadcast(spark.range(1_000_001).select(F.lit("a").alias("p")), ["p"])
    assert not fits_broadcast(spark.createDataFrame([("x" * (17 << 20),)], "p string"), ["p"])


def test_stage_reads_from_files(spark):
    staged = stage(spark.range(5).withColumn("x", F.rand()), "numbers")
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, staged.collect()))
    assert "FileScan" in staged._jdf.queryExecution().executedPlan().toString()
