"""Rows under names of their own, so that extra columns of any name pass through an operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, text: str) -> DataFrame:
    """Each row as one struct ``_row`` beside its text ``_text``."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs, never null, that name a row by its id and text.

    Rows equal in both share a key; what an operator decides is then the same for each of them.
    """
    return [
        F.xxhash64(doc_id.cast("string"), text).alias("_k1"),
        (F.shiftleft(F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)), 31) + F.hash(doc_id.cast("string"), F.length(text))).alias("_k2"),
    ]


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str, keep: list[str]) -> DataFrame:
    """Add columns that ``work`` computes for each Arrow batch; ``keep`` names those that stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = work(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found.values()], [*keep, *found])
            batch = found = None  # else it stays beside the next one
            pa.default_memory_pool().release_unused()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    return df.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def text_function(work: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """``work`` on whole Arrow arrays as a column function of type ``kind``.

    Spark sends the arguments alone to Python and keeps the rows they belong to, so wide rows cost nothing there.
    Memory that a batch has freed goes back to the system before the next one.
    """

    def run(*columns: pa.Array) -> pa.Array:
        found = work(*columns)
        pa.default_memory_pool().release_unused()
        return found

    one: Any = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}[work.__code__.co_argcount]
    return F.arrow_udf(one, kind).asNondeterministic()  # else a filter on its result computes it once more below
