"""From a scored corpus to ordered shards, and from source datasets to a random subset."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import HashFraction, decoded_path, md5_fraction
from quarryline.operators import order, quality, sampling
from quarryline.session import stage
from quarryline.sources import corpus, sinks

# Scored corpora come without ids; where a row was read from is one.
SOURCE_ORDER = ["source_file", "source_row"]


#: More new files than this are not listed in a plan; the whole corpus is read again instead, with the same result.
MAX_NEW_FILES = 10_000


def scored_corpus(
    spark: SparkSession,
    source: str,
    sort_keys: Sequence[str] = quality.SORT_KEYS,
    prefix: str = "",
    num_files: int = -1,
    only: list[str] | None = None,
) -> DataFrame:
    """The corpus without embeddings, with its composite score and each row's place in the source; of ``only`` some files if given."""
    rows = corpus.scan_files(spark, only) if only else corpus.scan_corpus(spark, source, prefix, num_files)
    quality.require_columns(rows, ["text", *sort_keys])
    placed = rows.select("*", decoded_path().alias("source_file"), F.col("_metadata.row_index").alias("source_row"))
    return quality.composite_score(corpus.drop_heavy_columns(placed), sort_keys)


@dataclass(frozen=True)
class _Finished:
    """The published version of an output, if it was made with the same settings, and how its inputs differ from today's."""

    version: str
    new: list[str]
    more_new: bool
    gone: bool

    @property
    def unchanged(self) -> bool:
        return not self.new and not self.gone


def _finished(spark: SparkSession, output: str, settings: dict, inputs: DataFrame) -> _Finished | None:
    if not sinks.markers(spark, output, "_current-"):
        return None
    version = sinks.current_version(spark, output)
    if not sinks.markers(spark, version, _SETTINGS) or json.loads(sinks.read_marker(spark, f"{version}/{_SETTINGS}")) != settings:
        return None
    before = spark.read.schema(inputs.schema).parquet(f"{version}/_inputs")
    new = [r["path"] for r in inputs.join(before, ["path", "length"], "left_anti").limit(MAX_NEW_FILES + 1).collect()]
    gone = not before.join(inputs, ["path", "length"], "left_anti").isEmpty()
    return _Finished(version, new, len(new) > MAX_NEW_FILES, gone)


_SETTINGS = "_settings"


def _publish(spark: SparkSession, output: str, version: str, settings: dict, inputs: DataFrame) -> str:
    """Put what a version was made from beside its shards, then name it as current."""
    inputs.write.parquet(f"{version}/_inputs")
    sinks.write_marker(spark, f"{version}/{_SETTINGS}", json.dumps(settings))
    sinks.publish(spark, output, version)
    return version


def curate(
    spark: SparkSession,
    source: str,
    output: str,
    sort_keys: Sequence[str] = quality.SORT_KEYS,
    top_percent: float = 100.0,
    rows_per_shard: int = sinks.ROWS_PER_SHARD,
    prefix: str = "",
    num_files: int = -1,
    skip_sort: bool = False,
) -> str:
    """Write the best ``top_percent`` of the corpus as shards, best first; the new version's path.

    The whole corpus is written as ``text``, a part of it as ``score, text``, and with ``skip_sort`` all columns but the
    heavy ones in input order. Beside the shards each version keeps the list of its inputs, and where all rows are kept
    the order keys of its rows. A second run with the same settings and inputs does nothing and returns the version there
    is. If files came to an output of all rows, only these are read: they are merged with the shards, which bring their order from
    the kept keys. A changed or missing input, other settings, or a share of the best means a whole run.
    """
    if not 0 < top_percent <= 100:  # NaN fails, too
        raise ValueError(f"top_percent must be above 0 and at most 100, not {top_percent}")
    settings = {
        "job": "curate", "sort_keys": list(sort_keys), "top_percent": top_percent, "rows_per_shard": rows_per_shard, "prefix": prefix,
        "num_files": num_files, "skip_sort": skip_sort, "source": source,
    }
    inputs = stage(corpus.input_files(spark, source, prefix, num_files), "inputs")
    done = _finished(spark, output, settings, inputs)
    if done and done.unchanged:
        return done.version
    ranking = SOURCE_ORDER if skip_sort else ["-score", *SOURCE_ORDER]
    whole = skip_sort or top_percent >= 100
    merge = done is not None and whole and not done.gone and not done.more_new
    rows = scored_corpus(spark, source, sort_keys, prefix, num_files, done.new if merge else None)
    places = ["score", *SOURCE_ORDER]
    columns = [c for c in rows.columns if c not in places] if skip_sort else ["text"] if whole else ["score", "text"]
    keys = rows.select(*places)
    if merge:
        old = spark.read.parquet(f"{done.version}/_keys")
        shards = spark.read.parquet(done.version).select(*sinks.shard_columns(), "*").drop("shard")
        kept = shards.join(old, ["shard_id", "row_in_shard"]).drop("shard_id", "row_in_shard")
        rows, keys = corpus.union_by_name([kept, rows.select(*columns, *places)]), old.select(*places).unionByName(keys)
        columns = [c for c in rows.columns if c not in places]
    keys = stage(keys, "order-keys")
    if not whole:
        cut = order.split(keys, ranking)
        keys, rows = order.top_both(keys, rows, ranking, order.top_percent_count(cut.total_rows, top_percent), cut)
    version = sinks.write_version(rows, output, ranking, rows_per_shard, columns, keys=keys)
    if whole:
        order.shard_positions(keys, ranking, rows_per_shard).drop("rank").write.parquet(f"{version}/_keys")
    return _publish(spark, output, version, settings, inputs)


def random_subset(
    spark: SparkSession,
    configs: dict[str, str],
    output: str,
    ratio: float = sampling.DEFAULT_RATIO,
    seed: int = 42,
    rows_per_shard: int = sinks.ROWS_PER_SHARD,
    candidates: Sequence[str] = quality.TEXT_CANDIDATES,
    hash_fn: HashFraction = md5_fraction,
) -> str:
    """Draw a seeded subset of several configs and write it as shards in reading order; the version's path.

    A second run with the same settings and inputs returns the version there is.
    """
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must be above 0 and at most 1, not {ratio}")
    settings = {
        "job": "sample", "configs": configs, "ratio": ratio, "seed": seed, "rows_per_shard": rows_per_shard, "candidates": list(candidates),
        "hash": getattr(hash_fn, "__name__", str(hash_fn)),
    }
    inputs = stage(corpus.union_by_name([corpus.input_files(spark, path) for path in configs.values()]), "inputs")
    done = _finished(spark, output, settings, inputs)
    if done and done.unchanged:
        return done.version
    named = {c: quality.resolve_text_column(spark.read.parquet(path), candidates) for c, path in configs.items()}
    clean = quality.drop_blank_text(corpus.multi_config_scan(spark, configs, named))
    kept = sampling.hash_sample(clean, sampling.row_key(clean), ratio, seed, hash_fn)
    columns = ["text"]
    if "token_count" in kept.columns:
        kept = kept.withColumn("token_count", F.coalesce(F.col("token_count").cast("bigint"), F.lit(0)))
        columns.append("token_count")
    version = sinks.write_version(kept, output, ["config", "source_row"], rows_per_shard, columns)
    return _publish(spark, output, version, settings, inputs)


def subset_budget(
    spark: SparkSession,
    shards: str,
    token_col: str = "token_count",
    batch: int = sampling.DEFAULT_BATCH,
    token_fn: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Files, rows, tokens and iterations of written shards (a folder of Parquet files, or the current version where versions are published)."""
    rows = corpus.scan_corpus(spark, sinks.published(spark, shards))
    return sampling.token_budget(rows.select("*", F.col("_metadata.file_path").alias("file")), token_col, batch, token_fn=token_fn)


def quality_report(spark: SparkSession, source: str, sort_keys: Sequence[str] = quality.SORT_KEYS, prefix: str = "", num_files: int = -1) -> DataFrame:
    """Least, greatest and mean of every key and of the composite score of a corpus, ``(score)``, in one pass each."""
    rows = scored_corpus(spark, source, sort_keys, prefix, num_files)
    overall = quality.score_profile(rows).select(F.lit("(score)").alias("key"), "min", "max", "mean")
    return quality.quality_profile(rows, sort_keys).select("key", "min", "max", "mean").unionByName(overall)
