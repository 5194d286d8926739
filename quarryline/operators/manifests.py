"""Comparing listings: what is still to do, and how far a transfer is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending_inputs(source: DataFrame, processed: DataFrame, name: str = "name") -> DataFrame:
    """Inputs without a processed record, matched by source name."""
    return source.join(processed.select(name), name, "left_anti")


def ingest_counts(source: DataFrame, outcomes: DataFrame, name: str = "name") -> DataFrame:
    """Inputs and bytes by state: done, skipped, error (an outcome that says so), pending.

    ``outcomes`` has one row per handled input with a ``status`` and ``bytes`` written.
    """
    joined = source.join(outcomes, name, "left")
    return joined.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes")
    )


def percent(part: Column, whole: Column) -> Column:
    """A percentage, null when the whole is not positive."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 6))


def manifest_reconcile(source: DataFrame, local: DataFrame, destination: DataFrame) -> DataFrame:
    """Per file: sizes in the three places and its transfer state.

    A size below the source's is ``partial``; a file the source lacks is ``extra``.
    """
    sides = {"source_length": source, "local_length": local, "dest_length": destination}
    frames = [df.select("name", F.col("length").alias(column)) for column, df in sides.items()]
    joined = frames[0].join(frames[1], "name", "full_outer").join(frames[2], "name", "full_outer")

    def state(length: str) -> Column:
        return (
            F.when(F.col("source_length").isNull() & F.col(length).isNull(), "absent")
            .when(F.col("source_length").isNull(), "extra")
            .when(F.col(length).isNull(), "missing")
            .when(F.col(length) != F.col("source_length"), "partial")
            .otherwise("complete")
        )

    return joined.withColumn("local_state", state("local_length")).withColumn("dest_state", state("dest_length"))


def transfer_progress(source: DataFrame, local: DataFrame, destination: DataFrame) -> DataFrame:
    """Files and bytes in each place, in percent of the source."""
    listed = {"source": source, "local": local, "destination": destination}
    tagged = [frame.select(F.lit(place).alias("place"), "length") for place, frame in listed.items()]
    everything = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])

    def files(place: str) -> Column:
        return F.count(F.when(F.col("place") == place, 1))

    def size(place: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("place") == place, F.col("length"))), F.lit(0)).cast("bigint")

    rows = [
        F.struct(
            F.lit(place).alias("place"),
            files(place).alias("files"),
            size(place).alias("bytes"),
            percent(files(place), files("source")).alias("files_percent"),
            percent(size(place), size("source")).alias("bytes_percent"),
        )
        for place in listed
    ]
    return everything.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
