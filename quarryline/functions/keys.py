"""Sort keys as comparable structs, and the search that places a row among cut keys.

A sort order is a list of column names, a leading minus meaning descending, such as
``["-score", "doc_id"]``. Each row's key becomes a struct whose plain ascending comparison gives
that order, so ``key <= cut`` is an ordinary filter and needs no window.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_LAST = (1 << 63) - 1


def _wall_micros(column: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    minutes = F.unix_date(column.cast("date")).cast("bigint") * 1440 + F.hour(column) * 60 + F.minute(column)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint")


def key_fields(df: DataFrame, order: list[str]) -> list[Column]:
    """The key's fields, all ascending: descending numbers are mirrored."""
    fields: list[Column] = []
    for spec in order:
        descending = spec.startswith("-")
        name = spec[1:] if descending else spec
        column, dtype = F.col(name), df.schema[name].dataType
        if isinstance(dtype, T.TimestampType):
            column, dtype = F.unix_micros(column), T.LongType()
        elif isinstance(dtype, T.TimestampNTZType) and descending:
            column, dtype = _wall_micros(column), T.LongType()
        elif isinstance(dtype, T.DateType):
            column, dtype = F.unix_date(column), T.LongType()
        if isinstance(dtype, (T.IntegralType, T.BooleanType)):
            column = column.cast("bigint")
            # mirrored without overflow; nulls sort last, as in ORDER BY ... DESC
            fields.append(F.coalesce(F.bitwise_not(column), F.lit(_LAST)) if descending else column)
        elif isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
            column = column.cast("double")
            if descending:
                # NaN, the largest double, becomes null, which sorts first; null becomes NaN, which sorts last
                column = F.when(column.isNull(), F.lit(float("nan"))).when(~F.isnan(column), -column)
            fields.append(column)
        elif isinstance(dtype, (T.StringType, T.TimestampNTZType)) and not descending:
            fields.append(column)
        else:
            raise TypeError(f"cannot order by {spec}: {dtype.simpleString()}")
    return [field.alias(f"k{i}") for i, field in enumerate(fields)]


def key_struct(df: DataFrame, order: list[str]) -> Column:
    return F.struct(*key_fields(df, order))


def sort_columns(order: list[str]) -> list[Column]:
    """The same order as plain sort expressions, for windows and sorts."""
    return [F.desc(spec[1:]) if spec.startswith("-") else F.asc(spec) for spec in order]


def column_names(order: list[str]) -> list[str]:
    return list(dict.fromkeys(spec.lstrip("-") for spec in order))


def _dump(value: list | dict) -> str:
    return json.dumps(value, default=lambda moment: moment.isoformat())


def array_literal(values: list, element_type: T.DataType) -> Column:
    """A foldable array: one constant in the optimised plan, however long the list."""
    return F.from_json(F.lit(_dump(values)), T.ArrayType(element_type))


def key_literal(cut: dict, key_type: T.StructType) -> Column:
    return F.from_json(F.lit(_dump(cut)), key_type)


def first_column_bound(df: DataFrame, order: list[str], cut: dict, upper: bool) -> Column | None:
    """What a key at or below (else above) a cut says about the first order column itself.

    Only a hint beside the exact key comparison: a plain comparison reaches the Parquet reader, which
    can then skip row groups. None where the cut says nothing.
    """
    descending, name = order[0].startswith("-"), order[0].lstrip("-")
    dtype, value = df.schema[name].dataType, cut["k0"]
    if value is None or value != value:
        return None
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = -value if descending else value
    elif isinstance(dtype, T.IntegralType):
        if descending and value == _LAST:
            return None
        value = ~value if descending else value
    elif not isinstance(dtype, T.StringType):
        return None
    column = F.col(name)
    if upper == descending:
        return column >= F.lit(value)
    return (column <= F.lit(value)) | column.isNull()


def with_bucket(df: DataFrame, order: list[str], cuts: list[dict], key_type: T.StructType, name: str) -> DataFrame:
    """Add how many of the sorted cut keys lie below each row's key.

    A binary search with one column per halving: plain expressions that stay in generated code. Each
    halving carries only the cuts it can meet, so all of them together hold every cut once.
    """
    columns = df.columns
    if not cuts:
        return df.withColumn(name, F.lit(0))
    found = df.select(*columns, key_struct(df, order).alias("_key"), F.lit(0).alias("_at0"))
    bits = len(cuts).bit_length()
    for level in range(bits):
        stride = 1 << (bits - 1 - level)
        at = F.col(f"_at{level}")
        probe = F.get(array_literal(cuts[stride - 1 :: 2 * stride], key_type), F.shiftright(at, bits - level))
        passed = F.when(probe < F.col("_key"), stride).otherwise(0)
        found = found.select(*columns, "_key", (at + passed).alias(f"_at{level + 1}"))
    return found.select(*columns, F.col(f"_at{bits}").alias(name))
