"""Exact global order without a single-partition sort.

Everything that depends on a row's place in the whole table (rank, top percent, thresholds,
budget prefix, shards) starts from :func:`split`: cut keys taken from a small sample, then the
exact rows (and weight) between neighbouring cuts. The cuts live on the driver as constants, so a
row's bucket is a pure function of the row. Nothing needs caching, and a task that is run again
after an executor is lost gives the same answer.

Prefixes (`top_rows`, `budget_rows`) look into one bucket only to find the last key wanted and then
filter the table by that key, so wide columns such as the text are read but never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.keys import (
    array_literal,
    column_names,
    first_column_bound,
    key_literal,
    key_struct,
    sort_columns,
    with_bucket,
)

ROWS_PER_BUCKET = 1_000_000
MIN_ROWS_PER_BUCKET = 4_000
SAMPLES_PER_BUCKET = 32
MAX_SAMPLE = 250_000
MAX_BUCKETS = 50_000

_BUCKET = "_bucket"


@dataclass(frozen=True)
class Split:
    """Cut keys of one table under one order, with the rows and weight in each bucket."""

    order: list[str]
    key_type: T.StructType
    cuts: list[dict]
    rows: list[int]
    weight: list[int]

    @property
    def total_rows(self) -> int:
        return sum(self.rows)

    def place(self, df: DataFrame, name: str = _BUCKET) -> DataFrame:
        """The rows with the number of their bucket."""
        return with_bucket(df, self.order, self.cuts, self.key_type, name)

    def before(self, values: list[int]) -> list[int]:
        """Running totals of earlier buckets."""
        totals, running = [], 0
        for value in values:
            totals.append(running)
            running += value
        return totals

    def find(self, position: int) -> int:
        """The bucket that holds the row at a 0-based position."""
        for bucket, start in enumerate(self.before(self.rows)):
            if start <= position < start + self.rows[bucket]:
                return bucket
        raise IndexError(position)


def split(df: DataFrame, order: list[str], weight: str | None = None, buckets: int | None = None) -> Split:
    """Cut a table into nearly equal buckets of an order that ends in a unique column.

    Reads the order columns (and the weight) only. At most ``MAX_BUCKETS`` keys come back to the
    driver. The unique last column is what lets one hot score spread over many buckets.
    """
    key = key_struct(df, order).alias("key")
    key_type = df.select(key).schema["key"].dataType
    total = df.count()
    if buckets is None:
        parallelism = df.sparkSession.sparkContext.defaultParallelism
        worthwhile = min(parallelism, total // MIN_ROWS_PER_BUCKET)
        buckets = max(worthwhile, math.ceil(total / ROWS_PER_BUCKET))
    buckets = max(1, min(buckets, MAX_BUCKETS, total))
    cuts: list[dict] = []
    if buckets > 1:
        fraction = min(1.0, min(buckets * SAMPLES_PER_BUCKET, MAX_SAMPLE) / total)
        narrow = df.select(*column_names(order))
        sample = narrow if fraction == 1.0 else narrow.sample(fraction, seed=17)
        ordered = sample.select(key).agg(F.sort_array(F.collect_list("key")).alias("keys"))
        picks = F.transform(
            F.sequence(F.lit(1), F.lit(buckets - 1)),
            lambda i: F.get("keys", F.floor(i.cast("bigint") * F.size("keys") / buckets).cast("int")),
        )
        found = ordered.select(F.array_distinct(picks).alias("cuts")).first()["cuts"]
        cuts = [cut.asDict() for cut in found if cut is not None]
    if not cuts and weight is None:
        return Split(order, key_type, cuts, [total], [0])
    used = df.select(*column_names(order), (F.col(weight) if weight else F.lit(0)).cast("bigint").alias("_weight"))
    placed = with_bucket(used, order, cuts, key_type, _BUCKET)
    counted = placed.groupBy(_BUCKET).agg(F.count("*").alias("n"), F.sum("_weight").alias("w")).collect()
    rows, weights = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for row in counted:
        rows[row[_BUCKET]] = row["n"]
        weights[row[_BUCKET]] = row["w"] or 0
    return Split(order, key_type, cuts, rows, weights)


def _offset(values: list[int]) -> Column:
    return F.get(array_literal(values, T.LongType()), F.col(_BUCKET))


def _window(order: list[str]) -> WindowSpec:
    return Window.partitionBy(_BUCKET).orderBy(*sort_columns(order))


def _placed(df: DataFrame, cut: Split) -> DataFrame:
    """Every bucket in a task of its own."""
    return cut.place(df).repartitionById(len(cut.rows), F.col(_BUCKET))


def _ranked(placed: DataFrame, cut: Split, name: str) -> DataFrame:
    rank = _offset(cut.before(cut.rows)) + F.row_number().over(_window(cut.order)) - 1
    return placed.withColumn(name, rank.cast("bigint")).drop(_BUCKET)


def _running(placed: DataFrame, cut: Split, weight: str, name: str) -> DataFrame:
    value = F.coalesce(F.col(weight).cast("bigint"), F.lit(0))
    frame = _window(cut.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = _offset(cut.before(cut.weight)) + F.sum(value).over(frame) - value
    return placed.withColumn(name, before.cast("bigint")).drop(_BUCKET)


def global_rank(
    df: DataFrame, order: list[str], name: str = "rank", buckets: int | None = None, cut: Split | None = None
) -> DataFrame:
    """Add the 0-based position in the whole order: one shuffle, by bucket."""
    cut = cut or split(df, order, buckets=buckets)
    return _ranked(_placed(df, cut), cut, name)


def running_total(
    df: DataFrame, order: list[str], weight: str, name: str = "total_before", cut: Split | None = None
) -> DataFrame:
    """Add the summed weight of all earlier rows; null weights count as zero."""
    cut = cut or split(df, order, weight=weight)
    return _running(_placed(df, cut), cut, weight, name)


def _within(df: DataFrame, cut: Split, last_key: dict) -> Column:
    """Rows up to a key, itself included."""
    exact = key_struct(df, cut.order) <= key_literal(last_key, cut.key_type)
    bound = first_column_bound(df, cut.order, last_key, upper=True)
    return exact if bound is None else bound & exact


def _beyond(df: DataFrame, cut: Split, last_key: dict) -> Column:
    exact = key_struct(df, cut.order) > key_literal(last_key, cut.key_type)
    bound = first_column_bound(df, cut.order, last_key, upper=False)
    return exact if bound is None else bound & exact


def _only_buckets(df: DataFrame, cut: Split, wanted: set[int]) -> DataFrame:
    """Rows of a few buckets, found by comparing keys so that the rest stops at the scan."""
    keep = F.lit(False)
    for bucket in sorted(wanted):
        inside = F.lit(True)
        if bucket > 0:
            inside = inside & _beyond(df, cut, cut.cuts[bucket - 1])
        if bucket < len(cut.cuts):
            inside = inside & _within(df, cut, cut.cuts[bucket])
        keep = keep | inside
    return cut.place(df.filter(keep))


def rows_at(df: DataFrame, order: list[str], positions: list[int], cut: Split | None = None) -> DataFrame:
    """The rows at a few 0-based positions, with their ``rank``; only their buckets are sorted."""
    cut = cut or split(df, order)
    inside = _only_buckets(df, cut, {cut.find(p) for p in positions})
    return _ranked(inside, cut, "rank").filter(F.col("rank").isin(positions))


def top_rows(df: DataFrame, order: list[str], count: int, cut: Split | None = None) -> DataFrame:
    """The first ``count`` rows of the order, as a filter on the key of the last one."""
    return top_both(df, df, order, count, cut)[1]


def top_both(keys: DataFrame, df: DataFrame, order: list[str], count: int, cut: Split | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``count`` rows of a staged table of order columns, and the same rows of the table it was made from.

    Only ``keys`` is looked at to find the last one wanted.
    """
    cut = cut or split(keys, order)
    if count >= cut.total_rows:
        return keys, df
    if count <= 0:
        return keys.limit(0), df.limit(0)
    last = rows_at(keys.select(*column_names(order)), order, [count - 1], cut)
    key = last.select(key_struct(keys, order).alias("key")).first()["key"].asDict()
    return keys.filter(_within(keys, cut, key)), df.filter(_within(df, cut, key))


def budget_rows(df: DataFrame, order: list[str], weight: str, budget: int, cut: Split | None = None) -> DataFrame:
    """The rows whose earlier rows weigh less than the budget: the shortest prefix that covers it.

    Weights must not be negative. The row that crosses the budget is included.
    """
    cut = cut or split(df, order, weight=weight)
    if budget <= 0:
        return df.limit(0)
    before = cut.before(cut.weight)
    crossing = next((b for b, w in enumerate(cut.weight) if before[b] + w >= budget), None)
    if crossing is None:
        return df
    narrow = _only_buckets(df.select(*dict.fromkeys([*column_names(order), weight])), cut, {crossing})
    inside = _running(narrow, cut, weight, "total_before").filter(F.col("total_before") < budget)
    last = inside.agg(F.max(key_struct(df, order)).alias("key")).first()["key"].asDict()
    return df.filter(_within(df, cut, last))


def top_percent_count(rows: int, percent: float) -> int:
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    if rows == 0:
        raise ValueError("no rows to select from")
    return max(1, math.ceil(rows * (percent / 100.0)))


def top_percent(df: DataFrame, order: list[str], percent: float) -> DataFrame:
    """The best ``percent`` of all rows, at least one."""
    cut = split(df, order)
    return top_rows(df, order, top_percent_count(cut.total_rows, percent), cut)


def _marks(rows: int) -> dict[str, int]:
    if rows == 0:
        raise ValueError("no rows to rank")
    return {"top_10_percent": rows // 10, "top_25_percent": rows // 4, "median": rows // 2}


def _as_rows(named: dict[str, int], columns: tuple[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias(columns[0]), F.lit(v).cast("bigint").alias(columns[1])) for k, v in named.items()])


def rank_thresholds(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """The value at one tenth, one quarter and one half of the order, exactly."""
    narrow = df.select(*dict.fromkeys([*column_names(order), value]))
    cut = split(narrow, order)
    marks = _marks(cut.total_rows)
    found = rows_at(narrow, order, list(marks.values()), cut)
    return (
        found.withColumn("mark", F.explode(_as_rows(marks, ("label", "at"))))
        .filter(F.col("mark.at") == F.col("rank"))
        .select(F.col("mark.label").alias("threshold"), "rank", F.col(value).alias("value"))
    )


#: Size of a quantile sketch; a rank is off by at most about 0.55 % of the rows.
SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """The share of all rows by which a sketched quantile's rank may be off, at 99 % confidence, both sides.

    The normalised rank error of a KLL sketch of size k for a single query.
    """
    return 2.296 / k**0.9021


def rank_thresholds_sketched(df: DataFrame, value: str, k: int = SKETCH_K) -> DataFrame:
    """About the same values from a KLL sketch: one pass, one small sketch per task, merged; no sample, sort or second look.

    ``rank`` is the wanted place from the top, and ``error_rows`` how far the true place of ``value`` may be from it at 99 % confidence.
    Null and NaN values are not counted.
    """
    number = F.col(value).cast("double")
    usable = F.when(~F.isnan(number), number)
    sketch = df.agg(F.kll_sketch_agg_double(usable, F.lit(k)).alias("s"), F.count(usable).alias("n"))
    error = F.ceil(F.lit(rank_error(k)) * F.col("n") + 1).cast("bigint")
    marks = [
        F.struct(
            F.lit(name).alias("threshold"),
            F.expr(f"n div {part}").alias("rank"),
            F.kll_sketch_get_quantile_double("s", F.lit(1 - 1 / part)).alias("value"),
            error.alias("error_rows"),
        )
        for name, part in (("top_10_percent", 10), ("top_25_percent", 4), ("median", 2))
    ]
    return sketch.filter("n > 0").select(F.inline(F.array(*marks)))


def sort_by(df: DataFrame, order: list[str]) -> DataFrame:
    """The whole table in order: one range shuffle, spread over hot values by the last column."""
    return df.orderBy(*sort_columns(order))


def shard_positions(df: DataFrame, order: list[str], rows_per_shard: int, cut: Split | None = None) -> DataFrame:
    """Add ``rank``, ``shard_id`` and ``row_in_shard``."""
    ranked = global_rank(df, order, cut=cut)
    return ranked.withColumn("shard_id", F.expr(f"rank div {int(rows_per_shard)}")).withColumn(
        "row_in_shard", F.col("rank") % rows_per_shard
    )


def blocked_index(df: DataFrame, group: list[str], block: list[str], within: list[str], name: str) -> DataFrame:
    """A dense 0-based index per group, counted block by block so that no group sits in one task."""
    sizes = df.groupBy(*group, *block).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*group, *block).orderBy(*within)) - 1
    return (
        df.withColumn("_local", local)
        .join(starts, [*group, *block])
        .withColumn(name, (F.col("_start") + F.col("_local")).cast("bigint"))
        .drop("_start", "_local")
    )
