"""Evaluate checkpoints on a multiple-choice benchmark over many seeds, in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import tokens
from quarryline.operators import mcq, scoring
from quarryline.session import stage
from quarryline.sources import benchmarks, sinks

KEYS = ["checkpoint", "seed", "qid", "target_index", "option_idx"]

# Options (KEYS, prompt, completion) in, one score per option out.
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame | None
    runs: DataFrame
    summary: DataFrame


def bigram_scorer(corpus: DataFrame, alpha: float = 0.1, limit: int | None = None, token_fn: scoring.TokenFn = tokens) -> Scorer:
    """Score options with a bigram model of a corpus with a ``text`` column."""
    return lambda options: scoring.ngram_option_scores(corpus, options, KEYS, alpha, limit, token_fn)


def logprob_scorer(token_logprobs: DataFrame) -> Scorer:
    """Score options from token log-probabilities made elsewhere (KEYS, logprob)."""
    return lambda options: scoring.option_scores(token_logprobs, options, KEYS)


def evaluate(
    spark: SparkSession,
    eval_file: str,
    scorers: dict[str, Scorer],
    seeds: list[int],
    dev_file: str | None = None,
    fewshot_k: int = 3,
    max_examples: int | None = None,
    header: str = mcq.PROMPT_HEADER,
    output: str | None = None,
    overwrite: bool = False,
) -> Evaluation:
    """Prompts for every seed, scores per checkpoint, then accuracy per run and per checkpoint.

    Few-shot examples come from ``dev_file``, or from the evaluation file itself. With ``output``, runs that stand there are not
    made again unless ``overwrite`` is set; the result has them all. Predictions are those of this call.
    """
    done = _written_runs(spark, output) if output and not overwrite else None
    todo = {c: seeds for c in scorers} if done is None else _pending(spark, list(scorers), seeds, done)
    if done is not None and not any(todo.values()):
        asked = done.filter(F.col("checkpoint").isin(list(scorers)) & F.col("seed").isin(seeds))
        return Evaluation(None, asked, scoring.repeat_summary(asked))
    every_seed, seeds = seeds, sorted({s for some in todo.values() for s in some})
    examples = stage(mcq.normalize_mcq(benchmarks.mcq_scan(spark, eval_file)), "examples")
    dev = stage(mcq.normalize_mcq(benchmarks.mcq_scan(spark, dev_file)), "dev") if dev_file else examples
    if dev_file and dev.isEmpty():
        dev = examples
    targets = stage(mcq.example_index(examples, ["file_stem", "source_row"], max_examples), "targets")
    answered = targets.filter(F.col("answer_index").isNotNull())
    pool = stage(mcq.fewshot_pool(dev, ["file_stem", "source_row"]), "pool")
    shots = mcq.fewshot_select(answered, pool, fewshot_k, seeds)
    options = mcq.explode_options(mcq.build_prompts(answered, shots, pool, seeds, header))
    columns = ["seed", "qid", "target_index", "option_idx", "prompt", "completion"]
    options = stage(options.select(*columns, "answer_index"), "prompts")

    predictions = []
    for checkpoint, scorer in scorers.items():
        if not todo[checkpoint]:
            continue
        asked = options.filter(F.col("seed").isin(todo[checkpoint])).withColumn("checkpoint", F.lit(checkpoint))
        scores = scorer(asked.select(*KEYS, "prompt", "completion"))
        graded = scores.join(asked.select(*KEYS, "answer_index"), KEYS)
        predictions.append(scoring.predict_option(graded, ["checkpoint", "seed", "qid", "target_index"]))
    scored = predictions[0]
    for more in predictions[1:]:
        scored = scored.unionByName(more)
    scored = stage(scored, "predictions")

    skipped = targets.filter(F.col("answer_index").isNull()).agg(F.count("*")).first()[0]
    asked = spark.createDataFrame([(c, s) for c in scorers for s in todo[c]], "checkpoint string, seed long")
    counted = asked.join(scoring.mcq_accuracy(scored, ["checkpoint", "seed"]), ["checkpoint", "seed"], "left")
    counted = counted.na.fill(0, ["total_scored", "correct"]).na.fill(0.0, ["accuracy"])
    runs = counted.select("checkpoint", "seed", "total_scored", F.lit(skipped).cast("bigint").alias("total_skipped"), "correct", "accuracy")
    fresh = runs
    if done is not None:
        runs = runs.unionByName(done.filter(F.col("checkpoint").isin(list(scorers)) & F.col("seed").isin(every_seed)))
    summary = scoring.repeat_summary(runs)
    if output:
        runs = stage(runs, "runs")
        summary = scoring.repeat_summary(runs)
        sinks.write_results(fresh, scored, output, summary, mode="append" if done is not None else "overwrite" if overwrite else "error")
    return Evaluation(scored, runs, summary)


_RUNS = "checkpoint string, seed bigint, total_scored bigint, total_skipped bigint, correct bigint, accuracy double"


def _written_runs(spark: SparkSession, output: str) -> DataFrame | None:
    """The runs an output holds, or None where there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{output}/runs")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return stage(spark.read.csv(f"{output}/runs", header=True, schema=_RUNS), "runs-before")


def _pending(spark: SparkSession, checkpoints: list[str], seeds: list[int], done: DataFrame) -> dict[str, list[int]]:
    """The seeds that each checkpoint still lacks."""
    label = lambda name: scoring.parse_checkpoints(spark.createDataFrame([(name,)], "checkpoint string")).first()["label"]
    by_label = {label(name): name for name in checkpoints}
    named = spark.createDataFrame([(name,) for name in checkpoints], "checkpoint string")
    existing = scoring.parse_checkpoints(done.select("checkpoint", "seed"), keep=["seed"])
    left = scoring.pending_evals(named, min(seeds), max(seeds), existing).filter(F.col("seed").isin(seeds))
    todo = {name: [] for name in checkpoints}
    for row in left.select("label", "seed").orderBy("seed").collect():
        todo[by_label[row["label"]]].append(row["seed"])
    return todo


def compare_models(
    spark: SparkSession,
    eval_file: str,
    models: DataFrame,
    scorer: Callable[[str], Scorer],
    extra: DataFrame | None = None,
    seed: int = 42,
    output: str | None = None,
    **options,
) -> DataFrame:
    """Every model of a set, and extra ones, on one benchmark: a row each, with the error in place of an accuracy where one failed.

    ``models`` and ``extra`` have ``name, model``; ``scorer`` makes a scorer of a model. A model that fails does not stop the others.
    """
    extra = models.limit(0) if extra is None else extra
    results = []
    for row in models.select("name", "model").unionByName(extra.select("name", "model")).collect():
        try:
            run = evaluate(spark, eval_file, {row["name"]: scorer(row["model"])}, [seed], **options).runs.first()
            results.append((row["name"], run["accuracy"], run["correct"], run["total_scored"], run["total_skipped"], None))
        except Exception as error:  # noqa: BLE001  the table says what failed
            results.append((row["name"], None, None, None, None, f"error: {str(error).splitlines()[0][:200]}"))
    schema = "name string, accuracy double, correct bigint, total_scored bigint, total_skipped bigint, error string"
    table = scoring.model_comparison(models, extra, spark.createDataFrame(results, schema))
    if output:
        table.write.option("header", True).csv(output)
    return table
