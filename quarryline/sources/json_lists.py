"""Large JSON lists read by many tasks.

A JSON file whose rows are one list has no line ends to split at. It is read as text with a closing brace as the line end, so
Spark splits it by bytes like any text. What a piece means depends on what stands before it: whether it starts inside a
string, how deep it is, and which list it belongs to. Each is a sum (or a last value) over the earlier pieces, made per block
first and then over the few blocks of a file, so no task sees a file as a whole. The pieces of a record then come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.session import stage

# The names under which an object may hold its list, first choice first.
WRAPPERS = ("examples", "data")
_OPENS = rf'"({"|".join(WRAPPERS)})"\s*:\s*\['
# What stands before an object: separators, and elements that are none.
_TO_OBJECT = r'^(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+'
_PLACE = ["_file", "_block", "_seq"]


def _without_strings(text: Column, inside: bool) -> Column:
    """What of a text without escapes lies outside of strings."""
    return F.regexp_replace(F.concat(F.lit('"'), text) if inside else text, r'"[^"]*("|$)', "")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _opened(text: Column) -> Column:
    return _count(text, "{[") - _count(text, "]")


def _before(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the sum of a value over all earlier pieces of the file."""
    valued = pieces.withColumn("_v", value.cast("bigint"))
    sums = valued.groupBy("_file", "_block").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_file", "_block", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_start"))
    local = Window.partitionBy("_file", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = valued.withColumn("_local", F.coalesce(F.sum("_v").over(local), F.lit(0))).join(starts, ["_file", "_block"])
    return placed.withColumn(name, F.col("_start") + F.col("_local")).drop("_v", "_local", "_start")


def _latest(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """Add the last value that is not null among a piece and all earlier ones of the file."""
    last = pieces.groupBy("_file", "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_seq"))).alias("_l"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.select("_file", "_block", F.last("_l", ignorenulls=True).over(earlier).alias("_start"))
    local = Window.partitionBy("_file", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("_local", F.last(value, ignorenulls=True).over(local)).join(starts, ["_file", "_block"])
    return placed.withColumn(name, F.coalesce("_local", "_start")).drop("_local", "_start")


def json_list_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The objects of JSON lists as ``_file``, ``source_row`` (the place in the list) and ``record``, their text.

    A file is a list, or an object with the list under ``examples`` or else ``data``; its other keys may hold anything. List elements that are
    no objects are left out. Line breaks inside a record become blanks: in valid JSON they only stand between its parts.
    """
    read = spark.read.option("lineSep", "}").text(path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq")]
    pieces = stage(read.select(*place, "value"), "json-pieces")

    clean = F.regexp_replace("value", r"(?s)\\.", "__")
    key_at = F.regexp_instr("value", F.lit(_OPENS))
    before_key = F.regexp_replace(F.substr("value", F.lit(1), key_at - 1), r"(?s)\\.", "__")
    facts = [_count(clean, '"').alias("quotes"), (F.col("_block") == 0).alias("first"), F.substring(F.ltrim(F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")), 1, 1).alias("head")]
    facts += [F.when(key_at > 0, key_at).alias("key_at"), F.regexp_extract("value", _OPENS, 1).alias("key")]
    for state, inside in (("out", False), ("in", True)):
        rest = _without_strings(clean, inside)
        facts += [_opened(rest).alias(f"opened_{state}"), rest.rlike(r"^\s*\]").alias(f"ends_{state}"), _opened(_without_strings(before_key, inside)).alias(f"opened_before_key_{state}")]
    narrow = stage(pieces.select(*_PLACE, *facts), "json-facts")

    def seen(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))

    narrow = _before(narrow, F.col("quotes"), "quotes_before").withColumn("inside", F.col("quotes_before") % 2 == 1)
    closes = F.when((F.col("quotes_before") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    narrow = stage(narrow.select(*_PLACE, "inside", "head", "key", "key_at", seen("opened").alias("opened"), seen("ends").alias("ends"), seen("opened_before_key").alias("opened_before_key"), closes.alias("closes")), "json-strings")
    narrow = _before(narrow, F.col("opened") - F.col("closes"), "depth")

    # The list is one level down in a bare list, two in an object.
    form = narrow.groupBy("_file").agg(F.min_by("head", F.struct("_block", "_seq")).alias("form"))
    narrow = narrow.join(form, "_file").withColumn("base", F.when(F.col("form") == "[", 1).otherwise(2))
    heading = (F.col("form") != "[") & ((F.col("depth") <= 1) | ((F.col("depth") == 2) & F.col("ends")))
    opens = F.col("key_at").isNotNull() & (F.col("depth") + F.col("opened_before_key") == 1)
    stays = F.col("depth") + F.col("opened") >= 2
    narrow = narrow.withColumns({"opens": heading & opens & stays, "heading": heading})
    narrow = narrow.withColumn("named", F.when(F.col("opens"), F.col("key")).when(F.col("heading"), F.lit("")))
    narrow = stage(_latest(narrow, "named", "list"), "json-depths")

    wanted = narrow.filter("opens").groupBy("_file").agg(F.min_by("key", F.element_at(F.create_map(*(F.lit(x) for pair in zip(WRAPPERS, range(len(WRAPPERS))) for x in pair)), F.col("key"))).alias("wanted"))
    narrow = narrow.join(wanted, "_file", "left").filter((F.col("form") == "[") | (F.col("list") == F.col("wanted")))
    bare = (F.col("form") == "[") & (F.col("depth") <= 1)
    between = bare | F.col("opens") | (~F.col("heading") & (F.col("form") != "[") & (F.col("depth") == 2))
    at_start = between & (F.col("depth") + F.col("opened") > F.col("base"))
    member = at_start | (F.col("depth") > F.col("base"))
    narrow = narrow.withColumn("starts", at_start).filter(member)
    narrow = _before(narrow, F.col("starts").cast("int"), "earlier").select(*_PLACE, "starts", "opens", "inside", "key_at", (F.col("earlier") + F.col("starts").cast("int") - 1).alias("source_row"))

    whole = F.when(F.col("opens"), F.regexp_replace(F.substr("value", F.col("key_at")), f"^{_OPENS}", "")).otherwise(F.concat(F.when(F.col("inside"), '"').otherwise(""), "value"))
    text = F.concat(F.when(F.col("starts"), F.regexp_replace(whole, _TO_OBJECT, "")).otherwise(F.col("value")), F.lit("}"))
    joined = pieces.join(narrow, _PLACE).select("_file", "source_row", F.struct("_block", "_seq", text.alias("text")).alias("piece"))
    record = F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["text"]), "")
    records = joined.groupBy("_file", "source_row").agg(F.translate(record, "\r\n", "  ").alias("record"))
    return records.filter(F.col("record").startswith("{"))
