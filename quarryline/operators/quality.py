"""Quality scores and corpus cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import is_blank

# The default quality columns, in summing order, and the text column names tried.
SORT_KEYS = ("pedagogical_structure_average", "factual_accuracy_average", "lesson_engagement_average")
TEXT_CANDIDATES = ("text", "content", "raw_text")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")


def composite_score(df: DataFrame, keys: Sequence[str] = SORT_KEYS, name: str = "score", nan_as_null: bool = True) -> DataFrame:
    """Add the mean of the quality columns, nulls (and by default NaN) counting as zero."""
    require_columns(df, keys)

    def filled(key: str) -> Column:
        value = F.col(key).cast("double")
        if nan_as_null:
            value = F.nanvl(value, F.lit(None).cast("double"))
        return F.coalesce(value, F.lit(0.0))

    total = filled(keys[0])
    for key in keys[1:]:
        total = total + filled(key)
    return df.withColumn(name, total / len(keys))


def _profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """min, max and mean of several columns in one aggregate, one row per column."""
    measures = []
    for key in keys:
        value = F.col(key).cast("double")
        measures.append(
            F.struct(
                F.lit(key).alias("key"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
                F.round(F.avg(value), 6).alias("mean"),
            )
        )
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def quality_profile(df: DataFrame, keys: Sequence[str] = SORT_KEYS) -> DataFrame:
    """Per quality column: min, max, mean over the values present."""
    require_columns(df, keys)
    return _profile(df, keys)


def score_profile(df: DataFrame, score: str = "score") -> DataFrame:
    """min, max and mean of the composite, where missing parts were already filled."""
    return _profile(df, [score]).drop("key")


def resolve_text_column(df: DataFrame, candidates: Sequence[str] = TEXT_CANDIDATES) -> str:
    """The first candidate column that exists and has any value; reading stops at the first value found."""
    for name in candidates:
        if name in df.columns and not df.select(name).filter(F.col(name).isNotNull()).isEmpty():
            return name
    raise ValueError(f"no text column: tried {list(candidates)}, available: {df.columns}")


def drop_blank_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop rows whose text is null or only white space; the text becomes a string."""
    return df.withColumn(text, F.col(text).cast("string")).filter(~is_blank(F.col(text)))
