"""Deterministic subsets, token budgets and experiment arms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.keys import column_names, key_literal, key_struct
from quarryline.functions.text import HashFraction, is_blank, md5_fraction
from quarryline.operators.order import rows_at, split, top_percent_count

DEFAULT_RATIO = 0.165
DEFAULT_BATCH = 524_288
TOKENIZER_DOC_CAP = 10_000
TOKENIZER_MAX_CHARS = 2_000_000_000


def row_key(df: DataFrame, text: str = "text", id_column: str = "id") -> Column:
    """``id`` where the row has one, else config, row number and the first 128 characters."""
    config = F.col("config") if "config" in df.columns else F.lit("")
    row = F.col("source_row").cast("string") if "source_row" in df.columns else F.lit("")
    composite = F.concat(config, F.lit(":"), row, F.lit(":"), F.substring(F.col(text).cast("string"), 1, 128))
    if id_column in df.columns:
        return F.coalesce(F.col(id_column).cast("string"), composite)
    return composite


def keep_condition(key: Column, ratio: float, seed: int = 42, hash_fn: HashFraction = md5_fraction) -> Column:
    """True for the share ``ratio`` of keys whose seeded hash falls below it."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")
    return hash_fn(F.concat(F.lit(f"{seed}|"), key)) < F.lit(float(ratio))


def hash_sample(
    df: DataFrame, key: Column, ratio: float = DEFAULT_RATIO, seed: int = 42, hash_fn: HashFraction = md5_fraction
) -> DataFrame:
    """A subset that depends on the seed and each row's key alone: a filter, no shuffle."""
    return df.filter(keep_condition(key, ratio, seed, hash_fn))


def sampling_report(
    df: DataFrame, key: Column, ratio: float, rows_per_shard: int, seed: int = 42, text: str = "text"
) -> DataFrame:
    """Rows seen, kept and kept in percent, per config and overall (labelled ``(all)``), with shard counts."""
    kept = ~is_blank(F.col(text)) & keep_condition(key, ratio, seed)
    per_config = df.groupBy("config").agg(
        F.count("*").alias("seen"), F.sum(F.when(kept, 1).otherwise(0)).alias("kept")
    )
    return (
        per_config.rollup("config")
        .agg(F.grouping("config").alias("_total"), F.sum("seen").alias("seen"), F.sum("kept").alias("kept"))
        .select(
            F.when(F.col("_total") == 1, F.lit("(all)")).otherwise(F.col("config")).alias("config"),
            "seen",
            "kept",
            F.round(100.0 * F.col("kept") / F.col("seen"), 6).alias("keep_rate_percent"),
            F.ceil(F.col("kept") / rows_per_shard).cast("bigint").alias("shards"),
        )
    )


def iterations(tokens: Column, batch: int) -> Column:
    """Whole optimisation steps that cover the tokens, zero when there are none."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    return F.when(tokens > 0, F.ceil(tokens / F.lit(batch)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def token_budget(
    df: DataFrame,
    token_col: str = "token_count",
    batch: int = DEFAULT_BATCH,
    file_col: str = "file",
    token_fn: Callable[[Column], Column] | None = None,
    text: str = "text",
) -> DataFrame:
    """Files, rows, tokens and training iterations of a subset, in one row.

    With ``token_fn``, which makes an array of tokens of a text, the tokens of the text column are counted instead of a
    token column. Without either the row says so and lists the columns there are.
    """
    if token_fn is not None:
        tokens = F.greatest(F.size(token_fn(F.col(text))), F.lit(0)).cast("bigint")
        status, message = "ok", None
    elif token_col in df.columns:
        tokens = F.coalesce(F.col(token_col).cast("bigint"), F.lit(0))
        status, message = "ok", None
    else:
        tokens = F.lit(None).cast("bigint")
        status = "missing_token_col"
        message = f"no column {token_col}; available: {sorted(c for c in df.columns if c != file_col)}"
    per_file = df.groupBy(file_col).agg(F.count("*").alias("rows"), F.sum(tokens).alias("tokens"))
    total = per_file.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.sum("tokens").alias("tokens"),
    )
    found = F.coalesce("tokens", F.lit(0)).cast("bigint") if status == "ok" else F.lit(None).cast("bigint")
    steps = iterations(found, batch) if status == "ok" else F.lit(None).cast("bigint")
    return total.select(
        F.lit(status).alias("status"),
        F.lit(message).cast("string").alias("message"),
        "files",
        F.col("rows").cast("bigint").alias("rows"),
        found.alias("tokens"),
        F.lit(batch).cast("bigint").alias("total_batch_size"),
        steps.alias("num_iterations"),
    )


def arm_summary(
    df: DataFrame, order: list[str], percent: float, ratio: float, key: Column, tokens: str, batch: int, seed: int = 42
) -> DataFrame:
    """The top arm beside the random arm: documents, tokens, iterations and score statistics.

    Both arms come from one pass over the table; a document may be in either, both or neither.
    """
    narrow = df.select(*column_names(order))
    cut = split(narrow, order)
    last = rows_at(narrow, order, [top_percent_count(cut.total_rows, percent) - 1], cut)
    last_key = last.select(key_struct(narrow, order).alias("key")).first()["key"].asDict()
    membership = {
        f"top{percent:g}": key_struct(df, order) <= key_literal(last_key, cut.key_type),
        f"random{100 * ratio:g}": keep_condition(key, ratio, seed),
    }
    score = F.col(order[0].lstrip("-"))
    measures = []
    for arm, inside in membership.items():
        measures.append(
            F.struct(
                F.lit(arm).alias("arm"),
                F.count(F.when(inside, 1)).alias("docs"),
                F.coalesce(F.sum(F.when(inside, F.col(tokens))), F.lit(0)).cast("bigint").alias("tokens"),
                F.round(F.avg(F.when(inside, score)), 6).alias("mean_score"),
                F.min(F.when(inside, score)).alias("min_score"),
                F.max(F.when(inside, score)).alias("max_score"),
            )
        )
    arms = df.agg(F.array(*measures).alias("arms")).select(F.inline("arms"))
    return arms.withColumn("num_iterations", iterations(F.col("tokens"), batch))


def comparability_check(configs: DataFrame, run: str, fields: Sequence[str]) -> DataFrame:
    """Which settings differ between runs: one row per field with its number of distinct values."""
    long = configs.select(
        run, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f")
    ).select(run, "f.field", "f.value")
    values = long.groupBy("field", "value").agg(F.count("*").alias("runs"))
    return values.groupBy("field").agg(
        F.sum("runs").alias("runs"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("runs"))), F.lit(0)).alias("runs_without"),
        F.min("value").alias("smallest"),
        F.max("value").alias("largest"),
    ).withColumn("comparable", (F.col("distinct_values") == 1) & (F.col("runs_without") == 0))


def tokenizer_text(df: DataFrame, text: str = "text", doc_cap: int = TOKENIZER_DOC_CAP) -> DataFrame:
    """Each document cut to the tokenizer's per-document limit, with its length."""
    return df.withColumn(text, F.substring(text, 1, doc_cap)).withColumn("chars", F.length(text).cast("bigint"))
