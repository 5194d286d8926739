"""Token counts: an exact histogram of encoded lengths that answers every context limit.

Documents are encoded whole; what is shuffled is one row per length and task. Suffix sums over the
histogram give, for any limit, the documents and tokens above it and the tokens left when each document is
cut there; the same sums give exact quantiles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPAN = 1_024


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a vocabulary of ranks; read once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document with ``n_tokens``; null and empty texts have none."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            found = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.int64))], ["n_tokens"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(lengths, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Documents of each length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length as a limit: documents and tokens at it and above it, and tokens after cutting there.

    Sums run inside spans of ``SPAN`` lengths, with the totals of the spans carried across, so no sort
    holds all lengths.
    """
    rows = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("_span", F.floor(F.col("n_tokens") / SPAN))
    spans = rows.groupBy("_span").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"), F.lit(0).alias("_one"))
    above = Window.partitionBy("_one").orderBy(F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        "_span", F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_da"), F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_ta"),
        (F.sum("_t").over(Window.partitionBy("_one"))).alias("_all"), F.sum("_d").over(Window.partitionBy("_one")).alias("_docs"),
    )
    inside = Window.partitionBy("_span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_di", F.sum("docs").over(inside)).withColumn("_ti", F.sum("tokens").over(inside)).join(carried, "_span")
    docs_from, tokens_from = F.col("_da") + F.col("_di"), F.col("_ta") + F.col("_ti")
    return summed.select(
        "n_tokens", "docs", "tokens", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("_all") - tokens_from + F.col("n_tokens") * docs_from).alias("tokens_cut"),
        (F.col("_docs") - docs_from + F.col("docs")).alias("docs_up_to"), F.col("_docs").alias("all_docs"), F.col("_all").alias("all_tokens"),
    )


def cut_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Exact tokens left for any limits, present as a length or not: each document keeps ``limit`` at most."""
    return sums.agg(
        *(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("docs")), F.lit(0)).alias(f"cut_{limit}") for limit in limits)
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed; null for no documents."""
    return sums.agg(
        *(F.min(F.when(F.col("docs_up_to") >= F.lit(s) * F.col("all_docs"), F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares))
    )


def token_histogram(docs: DataFrame, stage=lambda df, label: df, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The histogram of a table with its suffix sums, one row per length that occurs; no rows for an empty table.

    Null and empty texts count with length 0, repeated rows each count, other columns do not matter. The sums read the histogram
    twice: ``stage`` writes it, so that the documents are encoded once.
    """
    return suffix_sums(stage(histogram(encoded_lengths(docs, text, vocabulary)), "length-histogram"))
