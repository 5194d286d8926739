from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quarryline.catalog import sampling as sampled
from quarryline.catalog import streams
from quarryline.operators import quality, runs, sampling
from quarryline.sources import logs
from quarryline.streaming import jobs, tail

SCHEMA = "doc_id bigint, text string"


def _documents(spark, start, stop):
    text = F.when(F.col("id") % 9 == 0, "  \n").otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    return spark.range(start, stop).select(F.col("id").alias("doc_id"), text.alias("text"))


def test_sample_resumes_and_equals_the_batch_sample(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    key = F.col("doc_id").cast("string")

    def run():
        stream = jobs.stream_folder(spark, source, SCHEMA)
        jobs.stream_sample_ingest(stream, key, 0.3, out, str(tmp_path / "cp"), rows_per_shard=40).awaitTermination()
        return sorted(r["doc_id"] for r in jobs.read_stream_shards(spark, out).collect())

    def batch(stop):
        rows = quality.drop_blank_text(_documents(spark, 0, stop))
        return sorted(r["doc_id"] for r in sampling.hash_sample(rows, key, 0.3).collect())

    _documents(spark, 0, 500).write.mode("append").parquet(source)
    assert run() == batch(500)
    _documents(spark, 500, 800).write.mode("append").parquet(source)
    assert run() == batch(800)
    assert run() == batch(800)


def _shard_sizes(spark, out):
    rows = jobs.read_stream_shards(spark, out)
    sizes = rows.groupBy("shard_id").agg(F.count("*").alias("n"), F.max("row_in_shard").alias("last"), F.count_distinct("doc_id").alias("d")).orderBy("shard_id").collect()
    assert [r["shard_id"] for r in sizes] == list(range(len(sizes))) and all(r["last"] == r["n"] - 1 and r["d"] == r["n"] for r in sizes)
    return [r["n"] for r in sizes]


def test_shards_keep_their_size_over_batches_and_restarts(spark, tmp_path, monkeypatch):
    source, out, written = str(tmp_path / "in"), str(tmp_path / "out"), 0

    def run(files_per_batch=2):
        stream = jobs.stream_folder(spark, source, SCHEMA, files_per_batch=files_per_batch)
        jobs.stream_shards(stream, out, str(tmp_path / "cp"), 70).awaitTermination()

    monkeypatch.setattr(jobs.sinks, "ROWS_PER_TASK", 140)
    for step, rows in enumerate((200, 0, 15, 500)):
        _documents(spark, written, written + rows).repartition(5).write.mode("append").parquet(source)
        written += rows
        if step in (0, 3):  # the job stops after the files of a batch stand, before its marker does
            with monkeypatch.context() as broken:
                broken.setattr(jobs.sinks, "write_marker", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(Exception, match="lost"):
                    run()
        run()
        assert _shard_sizes(spark, out) == [70] * (written // 70) + ([written % 70] if written % 70 else [])
    assert sorted(r["doc_id"] for r in jobs.read_stream_shards(spark, out).collect()) == list(range(written))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("shard_*.parquet")}
    run()
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("shard_*.parquet")}


def test_a_repeated_batch_with_its_marker_writes_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _documents(spark, 0, 100).write.parquet(source)
    for checkpoint in ("one", "two"):  # a lost checkpoint repeats batch 0
        stream = jobs.stream_folder(spark, source, SCHEMA)
        jobs.stream_shards(stream, out, str(tmp_path / checkpoint), 30).awaitTermination()
        assert _shard_sizes(spark, out) == [30, 30, 30, 10]


def _lines(spark, start, stop):
    step = (F.col("id") % 5 * 250).cast("string")
    line = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Step "), step, F.lit(" | Validation bpb: 0."), F.col("id").cast("string"))).otherwise(
        F.concat(F.lit("Step "), step, F.lit(" | CORE metric: 0."), F.col("id").cast("string"))
    )
    return spark.range(start, stop).select(
        F.lit("r").alias("run"), F.lit(0).alias("phase_no"), F.floor(F.col("id") / 10).alias("block"), F.col("id").alias("seq"), line.alias("line")
    )


def test_milestones_follow_new_segments(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = _lines(spark, 0, 1).schema
    for start, stop in ((0, 40), (40, 55)):
        _lines(spark, start, stop).write.mode("append").parquet(source)
        jobs.stream_milestones(jobs.stream_folder(spark, source, schema), out, str(tmp_path / "cp")).awaitTermination()
        live = sorted(map(tuple, jobs.latest_snapshot(spark, out).collect()))
        assert live == sorted(map(tuple, runs.milestones(runs.parse_log(_lines(spark, 0, stop))).collect()))


def test_milestones_follow_logs_that_grow(spark, tmp_path):
    log = tmp_path / "logs" / "run-1-aa" / "files" / "output.log"
    log.parent.mkdir(parents=True)
    (tmp_path / "logs" / "other" / "files").mkdir(parents=True)
    (tmp_path / "logs" / "other" / "files" / "output.log").write_text("Step 1 | CORE metric: 0.9\n")
    specs = spark.createDataFrame([("r", "exp", ["aa"], "h", ["run-1-aa"], "all")], logs.SPEC_SCHEMA)
    phases, out = logs.run_phases(specs), str(tmp_path / "out")
    line = "Step {} | Validation bpb: 0.{}\n".format
    parts = [
        "".join(line(250 * (i % 5), 100 + i) for i in range(40)) + "Step 250 | Valid",  # stops inside a line
        "ation bpb: 0.777\r\n" + "progress 1\rprogress 2\rStep 500 | CORE metric: 0.25\n",
        "",
        line(9_000, 5) * 3,
    ]
    for part in parts:
        with log.open("ab") as stream:
            stream.write(part.encode())
        stream = tail.tail_logs(spark, str(tmp_path / "logs"), phases, split_bytes=100)
        jobs.stream_milestones(stream, out, str(tmp_path / "cp")).awaitTermination()
        whole = log.read_text()[: log.read_text().rfind("\n") + 1]
        copy = tmp_path / "copy" / "run-1-aa" / "files" / "output.log"
        copy.parent.mkdir(parents=True, exist_ok=True)
        copy.write_text(whole)
        batch = runs.milestones(runs.parse_log(logs.run_log_scan(spark, str(tmp_path / "copy"), phases)))
        assert sorted(map(tuple, jobs.latest_snapshot(spark, out).collect())) == sorted(map(tuple, batch.collect()))


def test_every_appended_line_comes_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    expected = []
    for turn in range(4):
        for name in ("a.log", "b.log", "skip.txt"):
            with (folder / name).open("a", encoding="utf-8") as stream:
                for i in range(turn * 30):
                    text = f"{name} {turn} {i} " + "é" * (i * 7 % 50)
                    stream.write(text + "\n")
                    expected += [text] if name != "skip.txt" else []
        tail.tail_text(spark, str(folder), "*.log", split_bytes=64).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")
        ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["value"] for r in rows) == sorted(expected) and len({(r["path"], r["offset"]) for r in rows}) == len(rows)
    assert tail.ranges({"x": 50}, {"x": 20, "y": 5}, 10) == [tail._Range("x", 0, 0, 10), tail._Range("x", 0, 10, 20), tail._Range("y", 0, 0, 5)]


def test_progress_follows_files_that_grow(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    manifest = spark.createDataFrame([("a", 0, 100), ("b", 1, 20), ("c", 0, 30)], "name string, worker bigint, length bigint")
    schema = "name string, length bigint"
    expected = [{0: (1, 40), 1: (1, 20)}, {0: (1, 100), 1: (1, 20)}, {0: (2, 110), 1: (1, 20)}, {0: (2, 110), 1: (1, 20)}]
    turns = [[("a", 40), ("b", 20), ("a", 10)], [("a", 100), ("a", 70), ("b", 20)], [("c", 10), ("a", 60), ("b", None)], [("unknown", 9)]]
    for arrived, totals in zip(turns, expected, strict=True):
        spark.createDataFrame(arrived, schema).write.mode("append").parquet(source)
        jobs.stream_transfer_progress(jobs.stream_folder(spark, source, schema), manifest, out, str(tmp_path / "cp")).awaitTermination()
        assert {r["worker"]: (r["files"], r["bytes"]) for r in jobs.latest_snapshot(spark, out).collect()} == totals


def test_finished_files_leave_the_state_and_growing_ones_stay(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    manifest = spark.createDataFrame([("done", 0, 10), ("open", 0, 10)], "name string, worker bigint, length bigint")
    schema = "name string, length bigint"

    def run(rows, days):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = jobs.stream_folder(spark, source, schema)
        jobs.stream_transfer_progress(stream, manifest, out, str(tmp_path / "cp"), days).awaitTermination()

    second = 1 / 86_400
    run([("done", 10), ("open", 4)], second)
    time.sleep(2)
    run([("open", 5)], second)
    state = spark.read.format("statestore").load(str(tmp_path / "cp"))
    assert [r["key"]["name"] for r in state.collect()] == ["open"]


def test_files_of_a_numbering_share_a_state_row_and_count_each_for_itself(spark, tmp_path):
    source, out, pick = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(7)
    names = [f"shard_{i:05d}.parquet" for i in (*range(0, 40), *range(980, 1020))] + [f"a/2024-05-17_{i}" for i in (7, 123456, 123457, 1123456)]
    names += ["shard_00###.parquet", "-123", "x12345678", "part-00012-0f12345e.parquet", "part-00013-0f12345e.parquet", "p\n00001", "p\n00002", ""]
    files = [(name, None if i % 7 == 0 else i % 3, None if i % 5 == 0 else 50 + i) for i, name in enumerate(names)]
    manifest, largest, worker = spark.createDataFrame(files, "name string, worker bigint, length bigint"), {}, {f[0]: f[1] for f in files}
    for turn in range(3):
        arrived = [(pick.choice([*names, "unlisted_00001"]), pick.choice([None, 0, -3, 20, 50, 120, 2**53 + 1])) for _ in range(90)] + [(None, 5)]
        spark.createDataFrame(arrived, "name string, length bigint").repartition(3).write.mode("append").parquet(source)
        jobs.stream_transfer_progress(jobs.stream_folder(spark, source, "name string, length bigint"), manifest, out, str(tmp_path / "cp")).awaitTermination()
        for name, length in arrived:
            if name in worker:
                largest[name] = max(largest.get(name, 0), length or 0)
        expected = {}
        for name, length in largest.items():
            n, size = expected.get(worker[name], (0, 0))
            expected[worker[name]] = (n + 1, size + length)
        assert {r["worker"]: (r["files"], r["bytes"]) for r in jobs.latest_snapshot(spark, out).collect()} == expected
    state = {r["key"]["name"]: r["value"]["groupState"] for r in spark.read.format("statestore").load(str(tmp_path / "cp")).collect()}
    assert sum(len(s["numbers"]) for s in state.values()) == len(largest)
    assert {"shard_00###.parquet", "shard_01###.parquet", "part-00###-0f12345e.parquet", "p\n00###"} <= set(state) and len(state) < 20


def test_a_finished_file_leaves_its_numbering_and_growing_ones_stay(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    names = ["shard_00001", "shard_00002", "other_00001", "other_00002"]
    manifest = spark.createDataFrame([(name, 0, 10) for name in names], "name string, worker bigint, length bigint")
    schema, second = "name string, length bigint", 1 / 86_400

    def run(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        jobs.stream_transfer_progress(jobs.stream_folder(spark, source, schema), manifest, out, str(tmp_path / "cp"), second).awaitTermination()
        state = spark.read.format("statestore").load(str(tmp_path / "cp")).collect()
        total = jobs.latest_snapshot(spark, out).first()
        return {r["key"]["name"]: sorted(r["value"]["groupState"]["numbers"]) for r in state}, (total["files"], total["bytes"])

    assert run(("shard_00001", 10), ("shard_00002", 4), ("other_00001", 10)) == ({"shard_00###": [1, 2], "other_00###": [1]}, (3, 24))
    time.sleep(2)  # "shard" is called with a growing file, "other" by the clock
    assert run(("shard_00002", 5)) == ({"shard_00###": [2]}, (3, 25))
    assert run(("shard_00002", 10), ("other_00002", 3)) == ({"shard_00###": [2], "other_00###": [2]}, (4, 33))
    time.sleep(2)
    assert run(("other_00002", 4)) == ({"other_00###": [2]}, (4, 34))
    assert run(("shard_00001", 10)) == ({"shard_00###": [1], "other_00###": [2]}, (5, 44))


def test_progress_counts_a_repeated_file_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    manifest = spark.createDataFrame([("a", 0, 10), ("b", 1, 20), ("c", 0, 30), ("d", 2, 5)], "name string, worker bigint, length bigint")
    schema = "name string, length bigint"
    for arrived in ([("a", 10), ("b", 20)], [("a", 10), ("c", 30), ("unknown", 1)]):
        spark.createDataFrame(arrived, schema).write.mode("append").parquet(source)
        stream = jobs.stream_folder(spark, source, schema)
        jobs.stream_transfer_progress(stream, manifest, out, str(tmp_path / "cp")).awaitTermination()
    report = {r["worker"]: tuple(r)[1:] for r in jobs.progress_report(jobs.latest_snapshot(spark, out), manifest).collect()}
    assert report == {0: (2, 40, 100.0, 100.0), 1: (1, 20, 100.0, 100.0), 2: (0, 0, 0.0, 0.0)}


def test_streams_take_a_table_that_is_a_folder(spark, tmp_path):
    rows = _documents(spark, 0, 200).select("doc_id", "text", F.lit("web").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = {r["shard"]: (r["rows"], r["first"], r["last"]) for r in streams.stream_shard_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {"shard_00000": (70, 0, 69), "shard_00001": (70, 0, 69), "shard_00002": (60, 0, 59)}
    kept = sampling.hash_sample(quality.drop_blank_text(rows, "text"), F.col("doc_id").cast("string"), sampled.RATIO, sampled.SEED)
    found = [r["doc_id"] for r in streams.stream_sample_ingest(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(r["doc_id"] for r in kept.collect()) and found
