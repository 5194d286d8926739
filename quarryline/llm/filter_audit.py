"""Filter interaction audit: which of several filters removes what, in every order they can be applied in.

Four filters look at one text each; the fifth fails a text that some smaller id has too. Its ids come from an existential
self-join: a left-semi join on hash, exact text and smaller id. They are united with the ids that fail otherwise, and a document
is from then on a combination of bits. Counts of equal combinations are all that the 120 orders are worked out from.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.rows import packed

FILTERS = "ABCDE"
BITS = {name: 1 << i for i, name in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
#: So many hashes of repeated texts, 8 bytes each, are sent to every executor at most; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000

_SPACES = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """The bits of the filters that need no other document than the text itself."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = {
        "A": n_words < MIN_WORDS,
        "B": 100 * n_distinct.cast("long") < 50 * n_words.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }
    bits = F.lit(0)
    for name, fails in tests.items():
        bits = bits + F.when(fails, BITS[name]).otherwise(0)
    return bits


def later_copies(rows: DataFrame, stage) -> DataFrame:
    """The ``rows`` (``doc_id``, ``h``, ``text``) whose text a smaller id has as well.

    Hashes that occur once need no text: only texts behind a repeated hash are moved. Each of them meets one row, the
    least id with that text, so a text that a third of all rows share is a skewed join that Spark splits.
    """
    again = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    if again.count() <= BROADCAST_HASHES:
        again = F.broadcast(again)
    suspects = rows.join(again, "h", "left_semi")
    # Written, as Spark splits a skewed join only where both sides come straight from a shuffle.
    least = stage(suspects.groupBy("h", "text").agg(F.min("doc_id").alias("least")).select(F.col("h").alias("_h"), F.col("text").alias("_text"), "least"), "least-ids")
    same = (F.col("h") == F.col("_h")) & (F.col("text") == F.col("_text")) & (F.col("least") < F.col("doc_id"))
    return suspects.join(least, same, "left_semi")


def combinations(docs: DataFrame, labels: DataFrame, stage) -> DataFrame:
    """Number of documents ``n`` per ``part``, set of failed filters ``bits``, and labels ``good`` and ``toxic``.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; other columns are not looked at. A null text is empty, a null language
    is the part ''. Rows repeat freely: each counts, and rows of one id and text fail alike. A row without an id is never a later
    copy and makes none, and has no label. An id with several labels is good (toxic) if one of them says so.
    """
    texts = packed(docs, "text")
    text = F.coalesce("_text", F.lit(""))
    rows = texts.select(F.coalesce(F.col("_row.lang").cast("string"), F.lit("")).alias("part"), F.col("_row.doc_id").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    own = stage(rows.select("part", "doc_id", "h", own_failures(F.col("text")).alias("bits")), "own-failures")
    later = later_copies(rows.select("doc_id", "h", "text"), stage).select("doc_id", "h").distinct()
    every = own.groupBy("part", "doc_id", "h", "bits").agg(F.count("*").alias("n"))
    marks = later.select(F.lit(None).cast("string").alias("part"), "doc_id", "h", F.lit(BITS["E"]).alias("bits"), F.lit(0).cast("long").alias("n"))
    by_id = (
        every.unionByName(marks)
        .groupBy("doc_id", "h")
        .agg(F.bit_or("bits").alias("bits"), F.collect_list(F.when(F.col("n") > 0, F.struct("part", "n"))).alias("parts"))
        .select("doc_id", "bits", F.inline("parts"))
        .groupBy("doc_id", "part", "bits")
        .agg(F.sum("n").alias("n"))
    )
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return (
        by_id.join(said, "doc_id", "left")
        .groupBy("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .agg(F.sum("n").alias("n"))
    )


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of filters and step, from the counts of ``combinations``.

    ``shapley`` needs no orders: of the 120, a filter comes first among the k that a document fails in 120 / k.
    """
    steps = counts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("before", "name"))
    bit = F.element_at(F.create_map(*(F.lit(x) for pair in BITS.items() for x in pair)), F.col("name"))
    steps = steps.withColumn("bit", bit).withColumn(
        "earlier", sum((F.when(F.locate(name, F.col("filter_order")) <= F.col("before"), b).otherwise(0) for name, b in BITS.items()), F.lit(0))
    )
    fails, removed_earlier = F.col("bits").bitwiseAND(F.col("bit")) > 0, F.col("bits").bitwiseAND(F.col("earlier")) > 0
    removed = fails & ~removed_earlier
    count = lambda test, n=F.col("n"): F.sum(F.when(test, n).otherwise(F.lit(0).cast("long")))
    return steps.groupBy("part", "filter_order", (F.col("before") + 1).alias("step")).agg(
        count(~fails & ~removed_earlier).alias("kept"),
        count(removed).alias("removed"),
        count(fails & removed_earlier).alias("redundant"),
        count(F.col("bits") == F.col("bit")).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
        count(fails, F.col("n") * (F.lit(len(ORDERS)) / F.bit_count("bits")).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, stage) -> DataFrame:
    """All interactions of the five filters on ``docs``; an empty table has no parts and so no rows."""
    return interactions(combinations(docs, labels, stage))


def oracle_sql() -> str:
    orders = ", ".join(f"'{o}'" for o in ORDERS)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
    failing AS (
        SELECT doc_id, part,
            (len(w) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
            + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
            + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS bits
        FROM words),
    said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    counts AS (
        SELECT part, bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
        FROM failing LEFT JOIN said USING (doc_id) GROUP BY ALL),
    steps AS (
        SELECT o AS filter_order, s AS step, (1 << (ascii(o[s]) - 65)) AS bit,
            list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))) AS earlier
        FROM (SELECT unnest([{orders}]) AS o), (SELECT unnest(range(1, 6)) AS s)),
    marked AS (
        SELECT *, (bits & bit) > 0 AS fails, (bits & coalesce(earlier, 0)::BIGINT) > 0 AS before FROM counts, steps)
    SELECT part, filter_order, step::INT AS step,
        sum(CASE WHEN NOT fails AND NOT before THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN fails AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails AND before THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails AND NOT before AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN fails AND NOT before AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost,
        sum(CASE WHEN fails THEN n * (120 // bit_count(bits)) ELSE 0 END)::BIGINT AS shapley
    FROM marked GROUP BY ALL"""
