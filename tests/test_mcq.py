from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from quarryline.operators import mcq, scoring
from quarryline.sources import benchmarks


def _normal(spark, rows, schema, **options):
    df = spark.createDataFrame(rows, schema)
    return {r["qid"]: r for r in mcq.normalize_mcq(df, **options).collect()}


def test_option_spellings(spark):
    rows = [
        ("json", '["a", " b ", ""]', None),
        ("bars", "a || b", None),
        ("semicolons", "a; b ;", None),
        ("broken json", "[a; b", None),
        ("single quotes", "['a', 'b']", None),
        ("choices", None, "x || y"),
        ("options win", "a || b", "x || y"),
    ]
    got = _normal(spark, [(q, "?", o, c) for q, o, c in rows], "id string, question string, options string, choices string")
    assert got["json"]["options"] == ["a", "b"]
    assert got["bars"]["options"] == ["a", "b"]
    assert got["semicolons"]["options"] == ["a", "b"]
    assert got["broken json"]["options"] == ["[a", "b"]
    assert "single quotes" not in got
    assert got["choices"]["options"] == ["x", "y"]
    assert got["options win"]["options"] == ["a", "b"]


def test_array_options_and_empty_array_falls_through(spark):
    got = _normal(spark, [("1", "?", ["a", None, " b "], "n", "m"), ("2", "?", [" "], "n", "m")], "id string, question string, options array<string>, A string, B string")
    assert got["1"]["options"] == ["a", "b"]
    assert got["2"]["options"] == ["n", "m"]


def test_column_per_option_styles(spark):
    got = _normal(spark, [("1", "?", "y", "", "x")], "id string, question string, `Answer B` string, `answer C` string, `Answer A` string")
    assert got["1"]["options"] == ["x", "y"]
    got = _normal(spark, [("1", "?", "two", "ten", "one")], "id string, question string, option_2 string, `option 10` string, Option1 string")
    assert got["1"]["options"] == ["one", "two", "ten"]


def test_a_present_style_hides_later_ones(spark):
    rows, schema = [("1", "?", "", "", "x", "y")], "id string, question string, A string, B string, option1 string, option2 string"
    assert _normal(spark, rows, schema) == {}
    rows = [("1", "?", None, None, "x", "y")]
    assert _normal(spark, rows, schema, per_row_keys=True)["1"]["options"] == ["x", "y"]


@pytest.mark.parametrize(
    ("answer", "index"),
    [("b", 1), (" B ", 1), ("E", None), ("0", 0), ("3", 3), ("4", 3), ("5", None), ("", None), ("banana", None), ("-1", None), ("99999999999999999999", None), (None, None)],
)
def test_text_answers(spark, answer, index):
    got = _normal(spark, [("1", "?", "a;b;c;d", answer)], "id string, question string, options string, answer string")
    assert got["1"]["answer_index"] == index


@pytest.mark.parametrize(("answer", "index"), [(0, 0), (3, 3), (4, None), (-1, None)])
def test_integer_answers_are_zero_based_only(spark, answer, index):
    got = _normal(spark, [("1", "?", "a;b;c;d", answer)], "id string, question string, options string, label int")
    assert got["1"]["answer_index"] == index


def test_first_answer_column_with_a_value_decides(spark):
    rows = [("1", "?", "a;b", "zzz", 1), ("2", "?", "a;b", None, 1)]
    got = _normal(spark, rows, "id string, question string, options string, answer string, gold int")
    assert got["1"]["answer_index"] is None
    assert got["2"]["answer_index"] == 1


def test_questions_ids_and_dropped_rows(spark):
    rows = [(None, " ", "stem text ", "a;b", "f", 0), (None, "  ", "", "a;b", "f", 1), ("x", "q", None, "only", "f", 2)]
    got = _normal(spark, rows, "id string, ` Question ` string, STEM string, options string, file_stem string, source_row bigint")
    assert list(got) == ["f-0"]
    assert got["f-0"]["question"] == "stem text"


@pytest.fixture
def pool_and_targets(spark):
    """Forty examples; a third share one qid and some have no answer."""
    rows = [(i, "hot" if i % 3 == 0 else f"q{i}", f"question {i}", [f"o{i}a", f"o{i}b"], None if i % 10 == 7 else i % 2) for i in range(40)]
    examples = spark.createDataFrame(rows, "source_row bigint, qid string, question string, options array<string>, answer_index int").cache()
    pool = mcq.fewshot_pool(examples, ["source_row"]).cache()
    targets = mcq.example_index(examples, ["source_row"]).filter("answer_index is not null").cache()
    return examples, pool, targets


@pytest.mark.parametrize("k", [1, 3, 10])
def test_fewshot_contract(spark, pool_and_targets, k):
    _, pool, targets = pool_and_targets
    qids = {r["pos"]: r["qid"] for r in pool.collect()}
    shots = mcq.fewshot_select(targets, pool, k, [0, 5]).collect()
    chosen: dict = {}
    for r in shots:
        chosen.setdefault((r["seed"], r["target_index"], r["qid"]), []).append(r["pos"])
    assert len(chosen) == 2 * targets.count()
    for (_, _, qid), places in chosen.items():
        assert len(places) == len(set(places)) == k
        assert all(qids[p] != qid for p in places)
    again = mcq.fewshot_select(targets.repartition(5), pool, k, [0, 5]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, shots))


def test_fewshot_small_pool_is_taken_whole(spark, pool_and_targets):
    _, pool, targets = pool_and_targets
    size = pool.count()
    shots = mcq.fewshot_select(targets, pool, size, [0])
    counts = {r["qid"]: r["n"] for r in shots.groupBy("qid", "target_index").agg(F.count("*").alias("n")).collect()}
    hot = pool.filter("qid = 'hot'").count()
    assert counts["hot"] == size - hot
    assert counts["q1"] == size - 1
    assert mcq.fewshot_select(targets, pool, 0, [0]).count() == 0


def test_fewshot_draws_are_even(spark, pool_and_targets):
    _, pool, targets = pool_and_targets
    shots = mcq.fewshot_select(targets, pool, 3, list(range(0, 3000, 100)))
    counts = [r["n"] for r in shots.groupBy("pos").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == pool.count()
    assert max(counts) < 3 * min(counts)


def test_prompt_text(spark):
    rows = [(0, "a", "Why?", ["x", "y"], 0), (1, "b", "How?", ["u", "v", "w"], 2)]
    examples = spark.createDataFrame(rows, "source_row bigint, qid string, question string, options array<string>, answer_index int")
    pool = mcq.fewshot_pool(examples, ["source_row"])
    targets = mcq.example_index(examples, ["source_row"], first=1)
    shots = mcq.fewshot_select(targets, pool, 3, [7])
    row = mcq.build_prompts(targets, shots, pool, [7], header="H\n").first()
    assert row["prompt"] == "H\nQuestion: How?\nOptions:\nA. u\nB. v\nC. w\nAnswer: w\n\nQuestion: Why?\nOptions:\nA. x\nB. y\nAnswer:\n\n"
    assert [r["completion"] for r in mcq.explode_options(targets).orderBy("option_idx").collect()] == [" x", " y"]


@pytest.mark.parametrize(
    ("prompt", "completion", "limit", "expected"),
    [
        (5, 2, 10, (["p0", "p1", "p2", "p3", "p4"], ["c0", "c1"], 2)),
        (5, 2, 4, (["p3", "p4"], ["c0", "c1"], 2)),
        (5, 4, 4, ([], ["c0", "c1", "c2", "c3"], 3)),
        (5, 6, 4, ([], ["c2", "c3", "c4", "c5"], 3)),
        (0, 2, 4, ([], ["c0", "c1"], 1)),
        (3, 0, 2, (["p1", "p2"], [], 0)),
    ],
)
def test_context_truncate(spark, prompt, completion, limit, expected):
    row = ([f"p{i}" for i in range(prompt)], [f"c{i}" for i in range(completion)])
    df = spark.createDataFrame([row], "prompt_tokens array<string>, completion_tokens array<string>")
    assert tuple(scoring.context_truncate(df, limit).first()) == expected


def test_scores_predictions_and_accuracy(spark):
    options = spark.createDataFrame([("m", q, o, g) for q, g in (("q1", 1), ("q2", 0), ("q3", None)) for o in range(3)], "run string, qid string, option_idx int, answer_index int")
    logs = [("q1", 0, -2.0), ("q1", 0, -4.0), ("q1", 1, -1.0), ("q2", 1, -1.0), ("q2", 2, -1.0)]
    tokens = spark.createDataFrame(logs, "qid string, option_idx int, logprob double")
    scores = scoring.option_scores(tokens, options, ["qid", "option_idx"]).join(options, ["qid", "option_idx"])
    by_key = {(r["qid"], r["option_idx"]): r["score"] for r in scores.collect()}
    assert by_key[("q1", 0)] == -3.0 and by_key[("q1", 2)] == -math.inf
    predicted = {r["qid"]: r for r in scoring.predict_option(scores, ["run", "qid"]).collect()}
    assert (predicted["q1"]["pred_index"], predicted["q1"]["pred_letter"], predicted["q1"]["correct"]) == (1, "B", True)
    assert predicted["q2"]["pred_index"] == 1
    assert predicted["q3"]["pred_index"] == 0
    assert predicted["q1"]["scores"] == [-3.0, -1.0, -math.inf]
    accuracy = scoring.mcq_accuracy(scoring.predict_option(scores, ["run", "qid"]), ["run"]).first()
    assert accuracy.asDict() == {"run": "m", "total_scored": 2, "total_skipped": 1, "correct": 1, "accuracy": 0.5}


def test_accuracy_without_gold_is_zero(spark):
    df = spark.createDataFrame([("m", 1, None)], "run string, pred_index int, gold_index int")
    assert scoring.mcq_accuracy(df, ["run"]).first()["accuracy"] == 0.0


def test_repeat_summary(spark):
    runs = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 0.5)], "checkpoint string, accuracy double")
    rows = {r["checkpoint"]: r for r in scoring.repeat_summary(runs).collect()}
    assert rows["a"]["std_accuracy"] == round(math.sqrt(0.02), 6)
    assert rows["a"]["ci95_half_width"] == round(1.96 * math.sqrt(0.02) / math.sqrt(2), 6)
    assert (rows["b"]["std_accuracy"], rows["b"]["ci95_half_width"]) == (0.0, 0.0)


def test_checkpoints_and_pending(spark):
    given = spark.createDataFrame([("d20",), (" d20:3000 ",), ("d26: LAST",), ("d26:",)], "checkpoint string")
    rows = [tuple(r) for r in scoring.parse_checkpoints(given).collect()]
    assert rows == [("d20", None, "d20:last"), ("d20", 3000, "d20:3000"), ("d26", None, "d26:last"), ("d26", None, "d26:last")]
    done = spark.createDataFrame([("d20:3000", 1)], "label string, seed bigint")
    some = given.limit(2)
    assert scoring.pending_evals(some, 0, 2, done).count() == 5
    assert scoring.pending_evals(some, 0, 2, done, overwrite=True).count() == 6
    with pytest.raises(ValueError):
        scoring.pending_evals(some, 3, 2, done)
    for bad in (":5", "a:b", "  "):
        with pytest.raises(Exception, match="invalid checkpoint"):
            scoring.parse_checkpoints(spark.createDataFrame([(bad,)], "checkpoint string")).collect()


@pytest.mark.parametrize("broadcast", [True, False])
def test_bigram_scores_against_brute_force(spark, monkeypatch, broadcast):
    from collections import Counter

    texts = ["the cat sat on the mat", "the dog sat", "cat the cat the cat", "one", ""] + ["the the the"] * 10
    options = [("q", 0, "Answer: the", " cat sat"), ("q", 1, "Answer: the", " dog dog"), ("q", 2, "", " one"), ("r", 0, "x", " sat on the mat")]
    monkeypatch.setattr(scoring, "fits_broadcast", lambda *_: broadcast)
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    df = spark.createDataFrame(options, "qid string, option_idx int, prompt string, completion string")
    got = {(r["qid"], r["option_idx"]): r["score"] for r in scoring.ngram_option_scores(corpus, df, ["qid", "option_idx"]).collect()}
    pairs, history, vocabulary = Counter(), Counter(), set()
    for words in (t.split() for t in texts):
        vocabulary |= set(words)
        for a, b in zip(words, words[1:]):
            pairs[a, b] += 1
            history[a] += 1
    for qid, i, prompt, completion in options:
        context = prompt.split()[-1:] + completion.split()
        logs = [math.log((pairs[a, b] + 0.1) / (history[a] + 0.1 * len(vocabulary))) for a, b in zip(context, context[1:])]
        assert got[qid, i] == pytest.approx(sum(logs) / len(logs) if logs else -math.inf)


def test_models_without_results_keep_their_error(spark, tmp_path):
    (tmp_path / "sets.json").write_text(json.dumps({"small": [{"name": "a", "model": "hub/a"}, {"name": "b", "model": "hub/b", "notes": "n"}]}))
    models = scoring.model_set(spark, str(tmp_path / "sets.json"), "small")
    extra = spark.createDataFrame([("c", "local/c")], "name string, model string")
    results = spark.createDataFrame([("a", 0.5, 1, 2, 0, None), ("b", None, None, None, None, "error: ValueError: x")], "name string, accuracy double, correct int, total_scored int, total_skipped int, error string")
    rows = {r["name"]: r["status"] for r in scoring.model_comparison(models, extra, results).collect()}
    assert rows == {"a": "ok", "b": "error: ValueError: x", "c": "error: no result"}
    with pytest.raises(KeyError):
        scoring.model_set(spark, str(tmp_path / "sets.json"), "large")


def test_scan_formats(spark, tmp_path):
    rows = [{"id": str(i), "question": f'q {i} "quoted", \n next', "options": "a;b", "answer": ""} for i in range(5)]
    (tmp_path / "bench.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "bench_list.json").write_text(json.dumps(rows))
    (tmp_path / "bench_examples.json").write_text(json.dumps({"examples": rows, "meta": 1}))
    (tmp_path / "bench_data.json").write_text(json.dumps({"data": rows}))
    import csv

    with (tmp_path / "bench.csv").open("w", newline="") as f:
        writer = csv.DictWriter(f, fieldnames=list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
    for name in ("bench.jsonl", "bench_list.json", "bench_examples.json", "bench_data.json", "bench.csv"):
        got = benchmarks.mcq_scan(spark, str(tmp_path / name)).orderBy("source_row").collect()
        assert [r["question"] for r in got] == [r["question"] for r in rows], name
        assert [r["source_row"] for r in got] == list(range(5))
        assert {r["file_stem"] for r in got} == {name.rsplit(".", 1)[0]}
        assert {r["answer"] for r in got} == {""}
    with pytest.raises(ValueError):
        benchmarks.mcq_scan(spark, str(tmp_path / "bench.xml"))


def test_combine_category_files(spark, tmp_path):
    folder = tmp_path / "dev"
    folder.mkdir()
    (folder / "CDPK_math_dev.csv").write_text('id,question\n1,"a\nb"\n2,c\n')
    (folder / "CDPK_art_dev.csv").write_text("id,question,hint\n3,d,e\n")
    (folder / "other_dev.csv").write_text("id\n9\n")
    combined = benchmarks.combine_category_files(spark, str(tmp_path), "dev")
    assert {(r["id"], r["question"], r["hint"], r["category_file"]) for r in combined.collect()} == {
        ("1", "a\nb", None, "CDPK_math_dev.csv"), ("2", "c", None, "CDPK_math_dev.csv"), ("3", "d", "e", "CDPK_art_dev.csv"),
    }
    assert benchmarks.combine_report(combined).first().asDict() == {"split": "dev", "files": 2, "rows": 3}
    with pytest.raises(FileNotFoundError):
        benchmarks.combine_category_files(spark, str(tmp_path), "test")
