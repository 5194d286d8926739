"""Subset, budget and placement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.catalog.tables import BLANKS_SQL, ORDER, SCORED_SQL, SHARDS_SQL, hash_sql, score_keys, shards, table, with_blanks
from quarryline.functions.text import blake2b_fraction
from quarryline.operators import placement, quality, sampling

RATIO = 0.165
SEED = 42
BATCH = 4096
WORLD = 8


def _id() -> F.Column:
    return F.col("doc_id").cast("string")


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.drop_blank_text(with_blanks(spark, sf_dir))
    return sampling.hash_sample(rows, _id(), RATIO, SEED).select("doc_id", "config", F.md5("text").alias("text_md5"))


def hash_sample_by_row_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.drop_blank_text(with_blanks(spark, sf_dir)).withColumn("source_row", F.col("doc_id"))
    rows = rows.withColumn("id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    return sampling.hash_sample(rows, sampling.row_key(rows), RATIO, SEED).select("doc_id")


def hash_sample_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return sampling.hash_sample(rows, _id(), RATIO, SEED, blake2b_fraction).select("doc_id", "source")


def sampling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampling_report(with_blanks(spark, sf_dir), _id(), RATIO, 50, SEED)


def _budget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("token_count")
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("file"), tokens)


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.token_budget(_budget_rows(spark, sf_dir), batch=BATCH)


def token_budget_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.token_budget(_budget_rows(spark, sf_dir), token_col="tokens", batch=BATCH)


def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.arm_summary(score_keys(spark, sf_dir), ORDER, 16.5, RATIO, _id(), "n_chars", BATCH, SEED)


def comparability_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("run"),
        F.lit("26").alias("depth"),
        (F.length("lang") * 262144).alias("batch"),
        F.when(F.col("doc_id") % 50 != 0, 94540).alias("iterations"),
        F.col("lang").alias("data"),
    )
    return sampling.comparability_check(configs, "run", ["depth", "batch", "iterations", "data"])


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.row_groups(placement.file_index(shards(spark, sf_dir)))


def rank_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.rank_assignment(_groups(spark, sf_dir), WORLD).select("name", "file_idx", "rg_idx", "rank")


def rank_assignment_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.rank_assignment(_groups(spark, sf_dir), WORLD, "val").select("name", "rg_idx", "rank")


def rank_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.floor(F.col("docs") / F.col("n_groups")) + F.when(F.col("rg_idx") < F.col("docs") % F.col("n_groups"), 1).otherwise(0)
    groups = _groups(spark, sf_dir).withColumn("tokens", F.floor(F.col("length") / F.col("n_groups"))).withColumn("docs", share)
    return placement.rank_balance(groups, WORLD)


QUERIES = {
    f.__name__: f
    for f in (
        hash_sample, hash_sample_by_row_key, hash_sample_blake2b, sampling_report, token_budget, token_budget_missing,
        arm_summary, comparability_check, rank_assignment, rank_assignment_validation, rank_balance,
    )
}

_KEEP = f"{hash_sql(f'''concat('{SEED}|', doc_id::VARCHAR)''')} < {RATIO}::DOUBLE"
_GROUPS = SHARDS_SQL + """,
files AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS file_idx FROM shards),
groups AS (SELECT *, unnest(range(n_groups)) AS rg_idx FROM files)"""
_RANK = f"CASE WHEN n_groups < {WORLD} THEN file_idx % {WORLD} ELSE rg_idx % {WORLD} END"

ORACLE = {
    "hash_sample": f"WITH {BLANKS_SQL} SELECT doc_id, config, md5(text) AS text_md5 FROM src WHERE NOT blank AND {_KEEP}",
    "hash_sample_by_row_key": f"""
      WITH {BLANKS_SQL}, keyed AS (
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE config || ':' || doc_id::VARCHAR || ':' || substr(text, 1, 128) END AS k
        FROM src WHERE NOT blank)
      SELECT doc_id FROM keyed WHERE {hash_sql(f"concat('{SEED}|', k)")} < {RATIO}::DOUBLE""",
    "sampling_report": f"""
      WITH {BLANKS_SQL}, marked AS (SELECT config, CASE WHEN NOT blank AND {_KEEP} THEN 1 ELSE 0 END AS kept FROM src),
      counted AS (SELECT coalesce(config, '(all)') AS config, count(*) AS seen, sum(kept)::BIGINT AS kept FROM marked GROUP BY ROLLUP (config))
      SELECT config, seen, kept, round(100::DOUBLE * kept / seen, 6) AS keep_rate_percent, ceil(kept / 50::DOUBLE)::BIGINT AS shards FROM counted""",
    "token_budget": f"""
      SELECT 'ok' AS status, NULL::VARCHAR AS message, count(DISTINCT doc_id // 50) AS files, count(*) AS rows,
        sum(CASE WHEN doc_id % 10 <> 0 THEN n_chars ELSE 0 END)::BIGINT AS tokens, {BATCH}::BIGINT AS total_batch_size,
        ceil(sum(CASE WHEN doc_id % 10 <> 0 THEN n_chars ELSE 0 END)::BIGINT / {BATCH}::DOUBLE)::BIGINT AS num_iterations FROM documents""",
    "token_budget_missing": f"""
      SELECT 'missing_token_col' AS status, 'no column tokens; available: [''token_count'']' AS message,
        count(DISTINCT doc_id // 50) AS files, count(*) AS rows, NULL::BIGINT AS tokens, {BATCH}::BIGINT AS total_batch_size,
        NULL::BIGINT AS num_iterations FROM documents""",
    "arm_summary": f"""
      WITH {SCORED_SQL}, ranked AS (SELECT doc_id, score, n_chars, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored),
      arms AS (
        SELECT 'top16.5' AS arm, * FROM ranked WHERE r <= greatest(1, ceil(n * (16.5::DOUBLE / 100::DOUBLE)))
        UNION ALL SELECT 'random16.5', * FROM ranked WHERE {_KEEP})
      SELECT arm, count(*) AS docs, sum(n_chars)::BIGINT AS tokens, round(avg(score), 6) AS mean_score, min(score) AS min_score,
        max(score) AS max_score, ceil(sum(n_chars)::BIGINT / {BATCH}::DOUBLE)::BIGINT AS num_iterations FROM arms GROUP BY arm""",
    "comparability_check": """
      WITH long AS (
        SELECT 'depth' AS field, '26' AS value FROM documents
        UNION ALL SELECT 'batch', (length(lang) * 262144)::VARCHAR FROM documents
        UNION ALL SELECT 'iterations', CASE WHEN doc_id % 50 <> 0 THEN '94540' END FROM documents
        UNION ALL SELECT 'data', lang FROM documents)
      SELECT field, count(*) AS runs, count(DISTINCT value) AS distinct_values, count(*) FILTER (value IS NULL) AS runs_without,
        min(value) AS smallest, max(value) AS largest, count(DISTINCT value) = 1 AND count(*) = count(value) AS comparable FROM long GROUP BY field""",
    "rank_assignment": f"WITH {_GROUPS} SELECT name, file_idx, rg_idx::INTEGER AS rg_idx, {_RANK} AS rank FROM groups",
    "rank_assignment_validation": f"WITH {_GROUPS} SELECT name, rg_idx::INTEGER AS rg_idx, r.rank FROM groups, (SELECT unnest(range({WORLD})) AS rank) r",
    "rank_balance": f"""
      WITH {_GROUPS}, loads AS (
        SELECT name, rg_idx, docs // n_groups + CASE WHEN rg_idx < docs % n_groups THEN 1 ELSE 0 END AS docs, length // n_groups AS tokens,
          rg_idx % {WORLD} AS by_group, {_RANK} AS by_file_or_group FROM groups),
      placed AS (SELECT 'by_group' AS rule, by_group AS rank, name, docs, tokens FROM loads
        UNION ALL SELECT 'by_file_or_group', by_file_or_group, name, docs, tokens FROM loads),
      ranks AS (SELECT rule, rank FROM (SELECT unnest(range({WORLD})) AS rank), (SELECT unnest(['by_group', 'by_file_or_group']) AS rule)),
      summed AS (
        SELECT rule, rank, count(DISTINCT name) AS files, count(name) AS groups, coalesce(sum(docs), 0)::BIGINT AS docs,
          coalesce(sum(tokens), 0)::BIGINT AS tokens FROM ranks LEFT JOIN placed USING (rule, rank) GROUP BY rule, rank)
      SELECT *, docs = 0 AS starving, round(max(docs) OVER (PARTITION BY rule) / avg(docs) OVER (PARTITION BY rule), 6) AS skew FROM summed""",
}
