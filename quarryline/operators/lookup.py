"""Joins against a table with one row per key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join whose right side is unique per key.

    Nothing is repeated. Spark broadcasts the right side where its measured size allows, and otherwise its
    adaptive execution splits the tasks of a hot left key by size and sends the one matching row to each part.
    """
    return left.join(right, keys, "left")


def fits_broadcast(df: DataFrame, text_columns: list[str]) -> bool:
    """Count the rows and text of a table: small enough to send to every executor?"""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in text_columns), F.lit(0))
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("chars")).first()
    return found["rows"] <= BROADCAST_ROWS and found["chars"] * 4 + found["rows"] * 64 <= BROADCAST_BYTES
