from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarryline.__main__ import main
from quarryline.operators import sampling, scoring
from quarryline.plans import curate, evaluate, track
from quarryline.session import stage
from quarryline.sources import logs, sinks
from tests.test_runs import _write_runs

KEYS = ("pedagogical_structure_average", "factual_accuracy_average", "lesson_engagement_average")


@pytest.fixture
def corpus(spark, tmp_path):
    rows = spark.range(100).select(
        F.concat(F.lit("document "), F.col("id").cast("string")).alias("text"),
        F.array(F.lit(1.0)).alias("embedding"),
        *[F.when(F.col("id") % 10 != 0, F.col("id") % (5 + i)).cast("double").alias(k) for i, k in enumerate(KEYS)],
    )
    rows.repartition(3).write.parquet(str(tmp_path / "corpus"))
    return str(tmp_path / "corpus")


def _in_order(spark, path):
    return [r["text"] for r in sinks.read_shards(spark, path).orderBy("shard_id", "row_in_shard").collect()]


def test_curate_full_and_top(spark, corpus, tmp_path):
    scored = curate.scored_corpus(spark, corpus).collect()
    best = [r["text"] for r in sorted(scored, key=lambda r: (-r["score"], r["source_file"], r["source_row"]))]
    curate.curate(spark, corpus, str(tmp_path / "full"), rows_per_shard=30)
    assert _in_order(spark, str(tmp_path / "full")) == best
    assert "score" not in sinks.read_shards(spark, str(tmp_path / "full")).columns
    curate.curate(spark, corpus, str(tmp_path / "top"), top_percent=16.5, rows_per_shard=5)
    assert _in_order(spark, str(tmp_path / "top")) == best[:17]
    assert {"score", "text"} <= set(sinks.read_shards(spark, str(tmp_path / "top")).columns)
    with pytest.raises(ValueError, match="missing"):
        curate.curate(spark, corpus, str(tmp_path / "bad"), sort_keys=["nope"])


def _files_read(df):
    """Names of the input files that a written plan may open."""
    return {name.rsplit("/", 1)[1] for name in df.inputFiles()}


def test_curate_again_reads_only_what_is_new(spark, corpus, tmp_path, monkeypatch):
    out, read = str(tmp_path / "out"), []
    scored_corpus = curate.scored_corpus

    def watched(*args, **kwargs):
        rows = scored_corpus(*args, **kwargs)
        read.append(_files_read(rows))
        return rows

    monkeypatch.setattr(curate, "scored_corpus", watched)

    def best():
        rows = scored_corpus(spark, corpus).collect()
        return [r["text"] for r in sorted(rows, key=lambda r: (-r["score"], r["source_file"], r["source_row"]))]

    first = curate.curate(spark, corpus, out, rows_per_shard=30)
    assert curate.curate(spark, corpus, out, rows_per_shard=30) == first and len(read) == 1
    before = {f.name for f in (tmp_path / "corpus").glob("*.parquet")}
    more = spark.read.parquet(corpus).filter("text LIKE '%7'").withColumn("text", F.concat(F.lit("new "), "text"))
    more = stage(more, "more")
    more.coalesce(1).write.mode("append").parquet(corpus)
    second = curate.curate(spark, corpus, out, rows_per_shard=30)
    assert second != first and _in_order(spark, out) == best() and len(best()) == 110
    assert read[1] == {f.name for f in (tmp_path / "corpus").glob("*.parquet")} - before
    assert [f.name for f in sorted((tmp_path / "out" / second.rsplit("/", 1)[1]).glob("shard_*"))] == [f"shard_{i:05d}.parquet" for i in range(4)]
    more.coalesce(1).write.mode("append").parquet(corpus)  # once more, onto merged shards
    curate.curate(spark, corpus, out, rows_per_shard=30)
    assert _in_order(spark, out) == best() and len(read[2]) == 1
    curate.curate(spark, corpus, out, rows_per_shard=20)  # other settings: a whole run
    assert _in_order(spark, out) == best() and len(read[3]) == 5
    next((tmp_path / "corpus").glob("*.parquet")).rename(tmp_path / "away.parquet")
    curate.curate(spark, corpus, out, rows_per_shard=20)
    assert _in_order(spark, out) == best() and len(read[4]) == 4
    assert curate.curate(spark, corpus, out, top_percent=10, rows_per_shard=20) == curate.curate(spark, corpus, out, top_percent=10, rows_per_shard=20)
    assert _in_order(spark, out) == best()[: len(_in_order(spark, out))]


def test_curate_without_sorting_keeps_columns_and_order(spark, corpus, tmp_path):
    out = str(tmp_path / "plain")
    curate.curate(spark, corpus, out, rows_per_shard=40, skip_sort=True)
    rows = curate.scored_corpus(spark, corpus).collect()
    assert _in_order(spark, out) == [r["text"] for r in sorted(rows, key=lambda r: (r["source_file"], r["source_row"]))]
    assert set(sinks.read_shards(spark, out).columns) == {"shard", "shard_id", "row_in_shard", "text", *KEYS}


def test_random_subset_and_budget(spark, tmp_path):
    for name, column in (("one", "content"), ("two", "content")):
        spark.range(300).select(F.concat(F.lit(name), F.col("id").cast("string")).alias(column), F.lit(5).alias("token_count")).write.parquet(str(tmp_path / name))
    configs = {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")}
    version = curate.random_subset(spark, configs, str(tmp_path / "out"), ratio=0.5, rows_per_shard=40)
    assert curate.random_subset(spark, configs, str(tmp_path / "out"), ratio=0.5, rows_per_shard=40) == version
    rows = sinks.read_shards(spark, str(tmp_path / "out")).count()
    assert 240 < rows < 360
    budget = curate.subset_budget(spark, version, batch=64).first()
    assert (budget["rows"], budget["tokens"]) == (rows, 5 * rows)
    assert budget["num_iterations"] == -(-5 * rows // 64)
    assert budget["files"] == -(-rows // 40)


@pytest.fixture
def benchmark(tmp_path):
    rows = [{"id": f"q{i}", "question": f"question {i}", "options": ["cat sat", "dog ran", f"x{i}"], "answer": "A" if i % 4 else None} for i in range(12)]
    (tmp_path / "bench.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(tmp_path / "bench.jsonl")


def test_evaluate_all_seeds_and_checkpoints(spark, benchmark, tmp_path):
    cats = spark.createDataFrame([("Answer: cat sat",)] * 20, "text string")
    dogs = spark.createDataFrame([("Answer: dog ran",)] * 20, "text string")
    scorers = {"cats:1": evaluate.bigram_scorer(cats), "dogs:1": evaluate.bigram_scorer(dogs)}
    found = evaluate.evaluate(spark, benchmark, scorers, [0, 1], output=str(tmp_path / "results"))
    runs = {(r["checkpoint"], r["seed"]): r for r in found.runs.collect()}
    assert len(runs) == 4
    assert (runs["cats:1", 0]["accuracy"], runs["dogs:1", 1]["accuracy"]) == (1.0, 0.0)
    assert (runs["cats:1", 0]["total_scored"], runs["cats:1", 0]["total_skipped"]) == (9, 3)
    assert found.summary.count() == 2
    assert spark.read.json(str(tmp_path / "results" / "rows")).count() == 36
    assert spark.read.csv(str(tmp_path / "results" / "runs"), header=True).count() == 4
    assert spark.read.csv(str(tmp_path / "results" / "aggregate"), header=True).count() == 2


def test_evaluation_resumes_where_it_stopped(spark, benchmark, tmp_path):
    cats = spark.createDataFrame([("Answer: cat sat",)] * 20, "text string")
    out, scored = str(tmp_path / "results"), []

    def scorer(name):
        inner = evaluate.bigram_scorer(cats)
        return lambda options: (scored.append((name, sorted(r[0] for r in options.select("seed").distinct().collect()))), inner(options))[1]

    evaluate.evaluate(spark, benchmark, {"cats:1": scorer("cats:1")}, [0, 1], output=out)
    again = evaluate.evaluate(spark, benchmark, {"cats:1": scorer("cats:1")}, [0, 1], output=out)
    assert scored == [("cats:1", [0, 1])] and again.predictions is None and again.runs.count() == 2 and again.summary.first()["runs"] == 2
    more = evaluate.evaluate(spark, benchmark, {"cats:1": scorer("cats:1"), "late": scorer("late")}, [0, 1, 2], output=out)
    assert scored[1:] == [("cats:1", [2]), ("late", [0, 1, 2])] and more.runs.count() == 6
    assert {(r["checkpoint"], r["runs"]) for r in more.summary.collect()} == {("cats:1", 3), ("late", 3)}
    assert spark.read.csv(f"{out}/runs", header=True).count() == 6 and spark.read.json(f"{out}/rows").count() == 6 * 9
    assert spark.read.csv(f"{out}/aggregate", header=True).count() == 2


def test_compare_keeps_models_that_fail(spark, benchmark, tmp_path):
    cats = spark.createDataFrame([("Answer: cat sat",)] * 20, "text string")
    models = spark.createDataFrame([("cats", "c"), ("broken", "b")], "name string, model string")
    extra = spark.createDataFrame([("more", "c")], "name string, model string")

    def scorer(model):
        if model == "b":
            raise RuntimeError("no such model")
        return evaluate.bigram_scorer(cats)

    table = evaluate.compare_models(spark, benchmark, models, scorer, extra, output=str(tmp_path / "table"), fewshot_k=1)
    found = {r["name"]: (r["accuracy"], r["status"]) for r in table.collect()}
    assert found == {"cats": (1.0, "ok"), "more": (1.0, "ok"), "broken": (None, "error: no such model")}
    assert spark.read.csv(str(tmp_path / "table"), header=True).count() == 3


def test_tokens_are_cut_by_the_given_function(spark):
    letters = lambda text: F.split(text, "")
    rows = spark.createDataFrame([("f", "abc"), ("f", ""), ("g", None)], "file string, text string")
    assert sampling.token_budget(rows.filter("text <> ''"), batch=2, token_fn=letters).first()["tokens"] == 3
    assert sampling.token_budget(rows, batch=2, token_fn=lambda t: F.array_remove(F.split(t, "-"), "")).first()["tokens"] == 1
    options = spark.createDataFrame([(1, 0, "ab", "ba"), (1, 1, "ab", "bb")], "qid int, option_idx int, prompt string, completion string")
    found = scoring.ngram_option_scores(spark.createDataFrame([("aba",)] * 9, "text string"), options, ["qid", "option_idx"], token_fn=letters)
    by_option = {r["option_idx"]: r["score"] for r in found.collect()}
    assert by_option[0] > by_option[1]


def test_evaluate_with_given_logprobs(spark, benchmark):
    logprobs = spark.range(12).select(
        F.lit("m").alias("checkpoint"), F.lit(3).cast("bigint").alias("seed"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("qid"),
        F.col("id").alias("target_index"), F.lit(1).alias("option_idx"), F.lit(-0.5).alias("logprob"),
    )
    found = evaluate.evaluate(spark, benchmark, {"m": evaluate.logprob_scorer(logprobs)}, [3], fewshot_k=0)
    assert {r["pred_index"] for r in found.predictions.collect()} == {1}


def test_track(spark, tmp_path):
    path = _write_runs(tmp_path)
    specs = spark.createDataFrame([("split run", "exp", ["aa", "bb"], "h", ["run-1-aa", "run-2-bb"], "all")], logs.SPEC_SCHEMA)
    tables = track.track_runs(spark, path, specs, output=str(tmp_path / "json"))
    assert {r["step"]: r["phase"] for r in tables.milestones.collect()}[2000] == "phase B"
    assert tables.registry.first()["phases"] == 2
    assert tables.latest_eval.count() == 2
    assert spark.read.json(str(tmp_path / "json")).first()["step"] == 1000


def test_command_line(spark, corpus, tmp_path, capsys):
    main(["curate", corpus, str(tmp_path / "cli"), "--top-percent", "10", "--rows-per-shard", "4"])
    version = capsys.readouterr().out.strip().splitlines()[-1]
    assert spark.read.parquet(version).count() == 10
    main(["curate", corpus, str(tmp_path / "cli2"), "--skip-sort", "--report"])
    assert "(score)" in capsys.readouterr().out
    main(["sample", str(tmp_path / "cli3"), "--dataset", corpus, "--ratio", "0.5", "--hash", "blake2b"])
    assert 20 < sinks.read_shards(spark, str(tmp_path / "cli3")).count() < 80
    capsys.readouterr()
    main(["budget", str(tmp_path / "cli3"), "--count-words"])
    assert "|ok " in capsys.readouterr().out
    main(["budget", version])
    assert "missing_token_col" in capsys.readouterr().out
    main(["manifest", corpus])
    assert "files" in capsys.readouterr().out
    main(["reconcile", corpus, corpus, str(tmp_path / "cli")])
    assert "100.0" in capsys.readouterr().out
