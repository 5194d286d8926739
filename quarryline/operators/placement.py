"""How shards spread over training ranks and transfer workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.order import global_rank


def file_index(files: DataFrame, name: str = "name") -> DataFrame:
    """Add ``file_idx``, the file's place by name."""
    return global_rank(files, [name], name="file_idx")


def row_groups(files: DataFrame) -> DataFrame:
    """One row per (file, row group) from ``n_groups``; ``rg_idx`` counts from zero."""
    return files.withColumn("rg_idx", F.explode(F.sequence(F.lit(0), F.col("n_groups").cast("int") - 1)))


def _train_rank(world: int) -> Column:
    by_file = F.col("file_idx") % world
    return F.when(F.col("n_groups") < world, by_file).otherwise(F.col("rg_idx") % world).cast("bigint")


def rank_assignment(groups: DataFrame, world: int, split: str = "train") -> DataFrame:
    """Add the ``rank`` that reads each row group.

    Files with fewer groups than ranks go whole to one rank, larger files are dealt out group by
    group. Validation files are read by every rank.
    """
    if split == "val":
        return groups.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(world - 1).cast("bigint"))))
    return groups.withColumn("rank", _train_rank(world))


def rank_balance(groups: DataFrame, world: int) -> DataFrame:
    """Load per rank under dealing by group alone and under :func:`rank_assignment`.

    ``groups`` carries ``docs`` and ``tokens`` of each row group. Ranks that get nothing show as
    zeros, and ``skew`` is the largest share of documents over the mean.
    """
    rules = F.array(
        F.struct(F.lit("by_group").alias("rule"), (F.col("rg_idx") % world).cast("bigint").alias("rank")),
        F.struct(F.lit("by_file_or_group").alias("rule"), _train_rank(world).alias("rank")),
    )
    placed = groups.withColumn("p", F.explode(rules)).select("p.rule", "p.rank", "name", "docs", "tokens")
    per_file = placed.groupBy("rule", "rank", "name").agg(
        F.count("*").alias("g"), F.sum("docs").alias("d"), F.sum("tokens").alias("t")
    )
    loads = per_file.groupBy("rule", "rank").agg(
        F.count("*").alias("files"), F.sum("g").alias("groups"), F.sum("d").alias("docs"), F.sum("t").alias("tokens")
    )
    spark = groups.sparkSession
    ranks = spark.range(world).select(
        F.col("id").alias("rank"), F.explode(F.array(F.lit("by_group"), F.lit("by_file_or_group"))).alias("rule")
    )
    def zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("bigint").alias(name)

    everyone = Window.partitionBy("rule")
    return (
        ranks.join(loads, ["rule", "rank"], "left")
        .select("rule", "rank", zero("files"), zero("groups"), zero("docs"), zero("tokens"))
        .withColumn("starving", F.col("docs") == 0)
        .withColumn("skew", F.round(F.max("docs").over(everyone) / F.avg("docs").over(everyone), 6))
    )


def stripe_files(files: DataFrame, workers: int, name: str = "name") -> DataFrame:
    """Add the transfer ``worker`` of each file: the sorted list dealt out in turn."""
    return file_index(files, name).withColumn("worker", F.col("file_idx") % workers)


def worker_load(striped: DataFrame) -> DataFrame:
    return striped.groupBy("worker").agg(F.count("*").alias("files"), F.sum("length").cast("bigint").alias("bytes"))
