"""From option log-probabilities to accuracies, and the corpus bigram scorer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import tokens
from quarryline.operators.lookup import fits_broadcast, lookup
from quarryline.session import stage

MINUS_INFINITY = float("-inf")

# A text column in, an array of its tokens out.
TokenFn = Callable[[Column], Column]


def context_truncate(df: DataFrame, limit: int, prompt: str = "prompt_tokens", completion: str = "completion_tokens") -> DataFrame:
    """Fit two token arrays into ``limit``: drop the oldest prompt tokens, then completion tokens.

    Adds ``scored_tokens``, the completion tokens that have a predecessor and so a score.
    """
    room = F.greatest(F.lit(limit) - F.size(completion), F.lit(0))
    too_long = F.size(prompt) + F.size(completion) > limit

    def last(column: str, count: Column) -> Column:
        return F.slice(column, F.size(column) - count + 1, count)

    cut_prompt = F.when(too_long, last(prompt, room)).otherwise(F.col(prompt))
    cut_completion = F.when(too_long & (room == 0), last(completion, F.lit(limit))).otherwise(F.col(completion))
    cut = df.withColumns({prompt: cut_prompt, completion: cut_completion})
    unscored_first = (F.size(prompt) == 0) & (F.size(completion) > 0)
    scored = F.when(unscored_first, F.size(completion) - 1).otherwise(F.size(completion))
    return cut.withColumn("scored_tokens", scored.cast("int"))


def completion_pairs(options: DataFrame, keys: list[str], limit: int | None = None, token_fn: TokenFn = tokens) -> DataFrame:
    """One row per scored completion token with the token before it.

    ``options`` has ``prompt`` and ``completion`` text beside the keys.
    """
    split = options.select(*keys, token_fn(F.col("prompt")).alias("prompt_tokens"), token_fn(F.col("completion")).alias("completion_tokens"))
    if limit is not None:
        split = context_truncate(split, limit)
    context = F.concat(F.slice("prompt_tokens", -1, 1), "completion_tokens")
    context = F.when(F.size("prompt_tokens") > 0, context).otherwise(F.col("completion_tokens"))
    found = split.select(*keys, F.posexplode_outer(_neighbours(context)).alias("token_no", "pair"))
    return found.filter(F.col("pair").isNotNull()).select(*keys, "token_no", F.col("pair.prev"), F.col("pair.tok"))


def _neighbours(words: Column) -> Column:
    count = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, 1, count).alias("prev"), F.slice(words, 2, count).alias("tok"))


_PAIRS, _WORDS = 1, 6  # grouping ids of the sets (prev, tok) and (word)


def corpus_counts(corpus: DataFrame, needed: DataFrame, text: str = "text", token_fn: TokenFn = tokens) -> DataFrame:
    """One pass over a corpus for both counts a bigram model needs, written: ``set``, ``prev``, ``tok``, ``word``, ``c``.

    Rows of the set ``_PAIRS`` count the needed (prev, tok) pairs, and under a null ``tok`` the other successors of a needed prev, so that
    the counts of one prev sum to its total. Rows of the set ``_WORDS`` are the vocabulary. While the needed pairs are few they are sent
    to the scan and everything else is dropped before the shuffle; otherwise all pairs are counted and reduced after.
    """
    words = token_fn(F.col(text))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    bigrams = corpus.select(F.inline(F.arrays_zip(before.alias("before"), words.alias("word")))).filter(F.col("word").isNotNull())
    histories = needed.select(F.col("prev").alias("before")).distinct().withColumn("known", F.lit(True))
    wanted = needed.select(F.col("prev").alias("before"), F.col("tok").alias("word"), F.lit(True).alias("wanted"))
    few = fits_broadcast(needed, ["prev", "tok"])
    if few:
        bigrams = bigrams.join(F.broadcast(histories), "before", "left").join(F.broadcast(wanted), ["before", "word"], "left")
        pair = [F.when(F.col("known"), F.col("before")), F.when(F.col("wanted"), F.col("word"))]
    else:
        pair = [F.col("before"), F.col("word")]
    rows = bigrams.select(pair[0].alias("prev"), pair[1].alias("tok"), "word")
    counted = rows.groupingSets([("prev", "tok"), ("word",)], "prev", "tok", "word").agg(F.grouping_id().alias("set"), F.count("*").alias("c"))
    counts = stage(counted.filter(f"set = {_WORDS} OR prev IS NOT NULL").select(F.col("set").cast("int").alias("set"), "prev", "tok", "word", "c"), "corpus-counts")
    if few:
        return counts
    pairs = lookup(counts.filter(f"set = {_PAIRS}").drop("word"), histories.withColumnRenamed("before", "prev"), ["prev"]).filter("known")
    pairs = lookup(pairs, wanted.withColumnsRenamed({"before": "prev", "word": "tok"}), ["prev", "tok"])
    reduced = pairs.groupBy("prev", F.when(F.col("wanted"), F.col("tok")).alias("tok")).agg(F.sum("c").alias("c"))
    reduced = reduced.select(F.lit(_PAIRS).alias("set"), "prev", "tok", F.lit(None).cast("string").alias("word"), "c")
    return stage(reduced.unionByName(counts.filter(f"set = {_WORDS}")), "corpus-counts")


def ngram_logprobs(corpus: DataFrame, pairs: DataFrame, alpha: float = 0.1, text: str = "text", token_fn: TokenFn = tokens) -> DataFrame:
    """Additively smoothed bigram log-probability of every needed pair; the corpus is read once."""
    needed = stage(pairs.select("prev", "tok").distinct(), "needed-pairs")
    found = corpus_counts(corpus, needed, text, token_fn)
    counts = found.filter(f"set = {_PAIRS}").select("prev", "tok", "c")
    of_pair = counts.filter(F.col("tok").isNotNull()).withColumnRenamed("c", "pair_count")
    of_history = counts.groupBy("prev").agg(F.sum("c").alias("history_count"))
    joined = lookup(needed.join(of_pair, ["prev", "tok"], "left"), of_history, ["prev"])
    words = found.filter(f"set = {_WORDS}").count()
    seen = F.coalesce("pair_count", F.lit(0)) + F.lit(alpha)
    total = F.coalesce("history_count", F.lit(0)) + F.lit(alpha * words)
    return joined.select("prev", "tok", F.log(seen / total).alias("logprob"))


def ngram_option_scores(
    corpus: DataFrame, options: DataFrame, keys: list[str], alpha: float = 0.1, limit: int | None = None, token_fn: TokenFn = tokens
) -> DataFrame:
    """Score options with a bigram model of the corpus: mean log-probability of the completion.

    ``token_fn`` cuts prompts, completions and the corpus alike; by default at white space.
    """
    pairs = stage(completion_pairs(options, keys, limit, token_fn), "completion-pairs")
    logprobs = ngram_logprobs(corpus, pairs, alpha, token_fn=token_fn)
    scored = lookup(pairs, logprobs, ["prev", "tok"])
    return option_scores(scored, options.select(*keys), keys)


def option_scores(token_logprobs: DataFrame, options: DataFrame, keys: list[str]) -> DataFrame:
    """Mean log-probability per option; an option without scored tokens gets minus infinity."""
    means = token_logprobs.groupBy(*keys).agg(F.avg("logprob").alias("score"))
    return options.select(*keys).join(means, keys, "left").withColumn("score", F.coalesce("score", F.lit(MINUS_INFINITY)))


def letter(index: Column) -> Column:
    return F.char(index + ord("A"))


def predict_option(scores: DataFrame, keys: list[str], gold: str = "answer_index") -> DataFrame:
    """The best option per example, the first one on ties, beside the gold option."""
    best = F.min_by("option_idx", F.struct(-F.col("score"), F.col("option_idx")))
    ordered = F.sort_array(F.collect_list(F.struct("option_idx", "score")))
    return (
        scores.groupBy(*keys)
        .agg(best.alias("pred_index"), F.max(gold).alias("gold_index"), ordered.alias("_scores"))
        .withColumn("scores", F.transform("_scores", lambda s: s["score"]))
        .drop("_scores")
        .withColumn("pred_letter", letter(F.col("pred_index")))
        .withColumn("gold_letter", letter(F.col("gold_index")))
        .withColumn("correct", F.col("pred_index") == F.col("gold_index"))
    )


def mcq_accuracy(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Scored, skipped (no gold), correct and accuracy per run; accuracy is 0 when nothing was scored."""
    has_gold = F.col("gold_index").isNotNull()
    counted = predictions.groupBy(*by).agg(
        F.count(F.when(has_gold, 1)).alias("total_scored"),
        F.count(F.when(~has_gold, 1)).alias("total_skipped"),
        F.count(F.when(has_gold & (F.col("pred_index") == F.col("gold_index")), 1)).alias("correct"),
    )
    accuracy = F.when(F.col("total_scored") > 0, F.col("correct") / F.col("total_scored")).otherwise(F.lit(0.0))
    return counted.withColumn("accuracy", accuracy)


def repeat_summary(runs: DataFrame, by: str = "checkpoint", accuracy: str = "accuracy") -> DataFrame:
    """Mean, sample deviation, 95% half width and range of the accuracy over a checkpoint's seeds."""
    value = F.col(accuracy)
    spread = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    def six(column: Column, name: str) -> Column:
        return F.round(column, 6).alias(name)

    return runs.groupBy(by).agg(
        F.count("*").alias("runs"),
        six(F.avg(value), "mean_accuracy"),
        six(spread, "std_accuracy"),
        six(1.96 * spread / F.sqrt(F.count("*")), "ci95_half_width"),
        six(F.min(value), "min_accuracy"),
        six(F.max(value), "max_accuracy"),
    )


def parse_checkpoints(checkpoints: DataFrame, column: str = "checkpoint", keep: Sequence[str] = ()) -> DataFrame:
    """``TAG`` or ``TAG:STEP`` as tag, step (null for the last one) and label, beside the columns to keep; bad values fail the job."""
    raw = F.trim(column)
    tag = F.trim(F.substring_index(raw, ":", 1))
    rest = F.lower(F.trim(F.when(raw.contains(":"), F.substring(raw, F.instr(raw, ":") + 1, F.length(raw))).otherwise(F.lit(""))))
    step = F.when(rest.isin("", "last", "latest"), F.lit(None).cast("bigint")).when(
        rest.rlike(r"^[+-]?\d+$"), rest.cast("bigint")
    )
    invalid = (tag == "") | ~(rest.isin("", "last", "latest") | rest.rlike(r"^[+-]?\d+$"))
    checked = F.when(invalid, F.raise_error(F.concat(F.lit("invalid checkpoint: "), column)).cast("string")).otherwise(tag)
    return checkpoints.select(
        checked.alias("tag"),
        step.alias("step"),
        F.concat(checked, F.lit(":"), F.coalesce(step.cast("string"), F.lit("last"))).alias("label"),
        *keep,
    )


def pending_evals(
    checkpoints: DataFrame, seed_start: int, seed_end: int, existing: DataFrame, overwrite: bool = False
) -> DataFrame:
    """The checkpoint and seed grid, both seed ends included, less the runs already present."""
    if seed_end < seed_start:
        raise ValueError("seed_end must not be below seed_start")
    seeds = F.sequence(F.lit(seed_start).cast("bigint"), F.lit(seed_end).cast("bigint"))
    grid = parse_checkpoints(checkpoints).withColumn("seed", F.explode(seeds))
    return grid if overwrite else grid.join(existing.select("label", "seed"), ["label", "seed"], "left_anti")


def model_set(spark, path: str, name: str) -> DataFrame:
    """The models of one named set in a JSON file of sets."""
    sets = spark.read.option("multiLine", True).json(path)
    if name not in sets.columns:
        raise KeyError(f"model set {name} not in {path}")
    return sets.select(F.inline(f"`{name}`")).select("name", "model")


def model_comparison(models: DataFrame, extra: DataFrame, results: DataFrame) -> DataFrame:
    """One row per model of the set and the extras; those without a result keep their error status."""
    everyone = models.select("name", "model").unionByName(extra.select("name", "model"))
    failed = F.coalesce("error", F.lit("error: no result"))
    return everyone.join(results, "name", "left").select(
        "name",
        "model",
        F.round("accuracy", 6).alias("accuracy"),
        "correct",
        "total_scored",
        "total_skipped",
        F.when(F.col("accuracy").isNotNull(), "ok").otherwise(failed).alias("status"),
    )
