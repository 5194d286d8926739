"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import (
    decontaminate,
    filter_audit,
    hard_negatives,
    interpolated_lm,
    main_text,
    piece_transducer,
    quality_rules,
    repeats,
    secret_ownership,
    sharding,
    simhash,
    token_counts,
    url_reputation,
)
from quarryline.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_histogram(_table(spark, sf_dir, "documents"), stage)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(_table(spark, sf_dir, "documents"), stage, with_text=True)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.token_table(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), stage)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), stage)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.scores(_table(spark, sf_dir, "documents"), stage)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"), stage)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.url_verdicts(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), url_reputation.RULES)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), stage)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), stage)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ownership.report(_table(spark, sf_dir, "documents"), stage)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontamination, op3_suffix_dedup, op4_sentencepiece, op5_sharding, op6_simhash, op7_lm_scoring,
        op8_html_extraction, op9_quality_rules, op10_url_filters, op11_hard_negatives, op12_filter_audit, op13_secret_scan,
    )
}
ORACLE = {
    "op10_url_filters": url_reputation.oracle_sql(),
    "op11_hard_negatives": hard_negatives.oracle_sql(),
    "op12_filter_audit": filter_audit.oracle_sql(),
}
