"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(links: DataFrame) -> tuple:
    found = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return found["n"], found["h"]


def components(links: DataFrame, stage) -> DataFrame:
    """Each node ``a`` that is not the least of its component with the least node ``b``.

    ``links`` has longs ``a`` and ``b``. Links are turned towards ever smaller nodes (large and small stars in
    turn) until nothing changes: about as many rounds as the logarithm of the longest path. Every round is
    two grouped minima and joins over the links that are left, written to the shared folder.
    """
    links = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        joined = large.join(least, F.col("a") == F.col("c"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
        links = stage(small.where("a <> b").distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links
