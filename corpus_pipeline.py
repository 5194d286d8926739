"""The corpus pipeline: stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import decontaminate, piece_transducer, quality_rules, repeats, simhash
from quarryline.session import stage

#: Shortest repeated string that the pipeline removes, in bytes: about 50 words.
REPEATED_BYTES = 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_filter(docs, stage)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints at three or fewer differing bits stays."""
    return simhash.keep_least(docs, stage)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that stand more than once in the corpus are cut out of the texts."""
    return repeats.without_repeats(docs, stage, REPEATED_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a few edits, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its token ids."""
    return piece_transducer.encoded(docs).select("_row.*", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: The stages need language models, fingerprints and tokenizers that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
