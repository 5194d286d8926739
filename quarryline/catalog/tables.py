"""The operators' inputs, derived from the driver tables; the SQL forms stand beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.quality import composite_score
from quarryline.session import stage

KEYS = ("pedagogical", "factual", "engagement")
ORDER = ["-score", "doc_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with three quality columns; documents without a label have real nulls."""
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.col("quality").cast("double").alias("pedagogical"),
        (1 - F.col("toxic")).cast("double").alias("factual"),
    )
    documents = table(spark, sf_dir, "documents").withColumn("engagement", F.col("n_chars") / 1000.0)
    return composite_score(documents.join(labels, "doc_id", "left"), KEYS)


def score_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, score and length of every document as a staged narrow table, for jobs that look at it more than once."""
    return stage(scored(spark, sf_dir).select("doc_id", "score", "n_chars"), "keys")


SCORED_SQL = """
scored AS (
  SELECT d.*, (coalesce(l.quality::DOUBLE, 0::DOUBLE) + coalesce((1 - l.toxic)::DOUBLE, 0::DOUBLE)
      + d.n_chars / 1000::DOUBLE) / 3 AS score,
    l.quality::DOUBLE AS pedagogical, (1 - l.toxic)::DOUBLE AS factual, d.n_chars / 1000::DOUBLE AS engagement
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def with_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a source dataset, every 17th text blank in one of three ways."""
    blank = F.element_at(F.array(F.lit("  \n"), F.lit(" \t"), F.lit(None)), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("config"),
        F.when(F.col("doc_id") % 17 == 0, blank).otherwise(F.col("text")).alias("text"),
        "n_chars",
    )


BLANKS_SQL = r"""
src AS (
  SELECT doc_id, source AS config, n_chars,
    CASE WHEN doc_id % 17 <> 0 THEN text WHEN doc_id % 3 = 0 THEN E'  \n' WHEN doc_id % 3 = 1 THEN chr(8195) || E'\t' END AS text,
    doc_id % 17 = 0 AS blank
  FROM documents
)"""


def hash_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard listing: fifty documents per shard, with row groups, rows and bytes."""
    shard = F.floor(F.col("doc_id") / 50)
    return (
        table(spark, sf_dir, "documents")
        .groupBy(shard.alias("shard_id"))
        .agg(F.count("*").alias("docs"), F.sum("n_chars").alias("length"))
        .select(
            "shard_id",
            F.format_string("shard_%05d", "shard_id").alias("name"),
            "docs",
            "length",
            (1 + F.col("shard_id") % 12).alias("n_groups"),
        )
    )


SHARDS_SQL = """
shards AS (
  SELECT doc_id // 50 AS shard_id, 'shard_' || lpad((doc_id // 50)::VARCHAR, 5, '0') AS name, count(*) AS docs,
    sum(n_chars)::BIGINT AS length, 1 + (doc_id // 50) % 12 AS n_groups
  FROM documents GROUP BY ALL
)"""


def local_copy(listing: DataFrame) -> DataFrame:
    """The listing part way through a transfer: some files missing, some cut short."""
    length = F.when(F.col("shard_id") % 11 == 0, F.floor(F.col("length") / 2)).otherwise(F.col("length"))
    return listing.filter(F.col("shard_id") % 7 != 0).select("name", length.alias("length"))


def destination_copy(listing: DataFrame) -> DataFrame:
    length = F.when(F.col("shard_id") % 5 == 0, F.col("length") - 1).otherwise(F.col("length"))
    name = F.when(F.col("shard_id") % 13 == 0, F.concat("name", F.lit("_old"))).otherwise(F.col("name"))
    return listing.filter(F.col("shard_id") % 3 != 0).select(name.alias("name"), length.alias("length"))


COPIES_SQL = SHARDS_SQL + """,
local_copy AS (
  SELECT name, CASE WHEN shard_id % 11 = 0 THEN length // 2 ELSE length END AS length FROM shards WHERE shard_id % 7 <> 0
),
destination AS (
  SELECT CASE WHEN shard_id % 13 = 0 THEN name || '_old' ELSE name END AS name,
    CASE WHEN shard_id % 5 = 0 THEN length - 1 ELSE length END AS length
  FROM shards WHERE shard_id % 3 <> 0
)"""


# --- training logs ---------------------------------------------------------------------------

LINES_PER_BLOCK = 1000


def _decimal(factor: int, digits: int) -> Column:
    number = (F.col("event_id") * factor) % (10**digits)
    return F.concat(F.lit("0."), F.lpad(number.cast("string"), digits, "0"))


def log_lines(events: DataFrame) -> DataFrame:
    """Events as the lines of four runs' training logs, three phases each, steps overlapping."""
    phase = F.when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2)
    step = 250 * (F.col("event_id") % 20 + 10 * F.col("phase_no"))
    padded = F.lpad(F.col("step").cast("string"), 5, "0")
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("step "), padded, F.lit("/10000 | loss: "), _decimal(31, 3)))
        .when(F.col("event_type") == "click", F.concat(F.lit("Step "), padded, F.lit(" | Validation bpb: "), _decimal(7919, 6)))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Step "), padded, F.lit(" | CORE metric: "), _decimal(104729, 4)))
        .when(
            F.col("event_type") == "error",
            F.concat(
                F.lit("Step "), padded, F.lit(" | CDPK accuracy: "), _decimal(1299709, 4),
                F.lit(" ("), (F.col("event_id") % 899).cast("string"), F.lit("/899)"),
            ),
        )
        .when(
            F.col("event_id") % 4 == 0,
            F.element_at(
                F.array(
                    F.concat(F.lit("Calculated number of iterations from target data:param ratio: "), F.format_number("event_id", 0)),
                    F.concat(F.lit("Using user-provided number of iterations: "), F.format_number("event_id", 0)),
                    F.concat(F.lit("Total number of training tokens: "), F.format_number(F.col("event_id") * 524288, 0)),
                    F.concat(F.lit("Total batch size "), F.format_number(F.col("event_id") * 1024, 0), F.lit(" => gradient accumulation steps: 4")),
                ),
                (F.floor(F.col("event_id") / 4) % 4 + 1).cast("int"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Evaluating: task_"), (F.col("event_id") % 22).cast("string"), F.lit(" ("),
                (F.col("event_id") % 11).cast("string"), F.lit("-shot, type: multiple_choice)... accuracy: "),
                _decimal(15485863, 4), F.lit(" | centered: "), F.when(F.col("event_id") % 5 == 0, "-").otherwise(""),
                _decimal(32452843, 4), F.lit(" | time: 1.2s"),
            ),
        )
    )
    return (
        events.withColumn("phase_no", phase)
        .withColumn("step", step)
        .select(
            F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("run"),
            "phase_no",
            F.floor(F.col("event_id") / LINES_PER_BLOCK).alias("block"),
            F.col("event_id").alias("seq"),
            line.alias("line"),
        )
    )


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(table(spark, sf_dir, "events"))


# The same events as numbers, without any text to parse.
EVENTS_SQL = """
ev AS (
  SELECT 'run' || (user_id % 4)::VARCHAR AS run, event_id AS pos, event_type, phase_no,
    CASE event_type WHEN 'view' THEN 'step' WHEN 'click' THEN 'val' WHEN 'purchase' THEN 'core' WHEN 'error' THEN 'cdpk'
      ELSE CASE WHEN event_id % 4 <> 0 THEN 'task' ELSE ['iterations_auto', 'iterations_fixed', 'tokens', 'batch_total'][(event_id // 4) % 4 + 1] END END AS kind,
    250 * (event_id % 20 + 10 * phase_no) AS step,
    CASE event_type WHEN 'click' THEN (event_id * 7919 % 1000000) / 1000000::DOUBLE
      WHEN 'purchase' THEN (event_id * 104729 % 10000) / 10000::DOUBLE
      WHEN 'error' THEN (event_id * 1299709 % 10000) / 10000::DOUBLE END AS value,
    event_id % 899 AS n,
    (event_id * 15485863 % 10000) / 10000::DOUBLE AS accuracy,
    CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END * ((event_id * 32452843 % 10000) / 10000::DOUBLE) AS centered
  FROM (SELECT *, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS phase_no FROM events)
),
ms AS (
  SELECT run, step, arg_max(value, pos) FILTER (kind = 'val') AS val, arg_max(value, pos) FILTER (kind = 'core') AS core,
    arg_max(value, pos) FILTER (kind = 'cdpk') AS cdpk, arg_max(n, pos) FILTER (kind = 'cdpk') AS n,
    arg_max(899, pos) FILTER (kind = 'cdpk') AS d, arg_max(phase_no, pos) AS last_phase
  FROM ev WHERE kind IN ('val', 'core', 'cdpk') GROUP BY run, step
),
owned AS (
  SELECT run, pos, accuracy, centered, 'task_' || (pos % 22)::VARCHAR AS task, pos % 11 AS shots, core_at
  FROM (SELECT *, min(CASE WHEN kind = 'core' THEN pos END) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS core_at FROM ev)
  WHERE kind = 'task' AND core_at IS NOT NULL
),
stepped AS (SELECT o.*, c.step FROM owned o JOIN ev c ON c.pos = o.core_at),
tasks AS (
  SELECT run, step, row_number() OVER (PARTITION BY run, step ORDER BY pos) - 1 AS task_no, task, shots, accuracy, centered
  FROM (SELECT *, max(core_at) OVER (PARTITION BY run, step) AS last_core FROM stepped) WHERE core_at = last_core
)"""


# --- multiple-choice items -------------------------------------------------------------------


def mcq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as multiple-choice rows in several spellings of options and answers.

    Each item's options are snippets of its three successors and of itself.
    """
    items = table(spark, sf_dir, "benchmark")
    size = items.count()
    snippet = F.trim(F.regexp_replace(F.col("text"), "[^A-Za-z ]", ""))
    offered = items.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct(
        ((F.col("item_id") + size - j) % size).alias("item_id"), ((j + 3) % 4).alias("place"), snippet.alias("option")))).alias("o")).select("o.*")
    options = offered.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("place", "option"))).alias("s"))
    joined = items.join(options, "item_id").withColumn("opts", F.transform("s", lambda s: s["option"]))
    style, gold = F.col("item_id") % 3, F.col("item_id") % 4
    answer = (
        F.when(F.col("item_id") % 5 == 0, F.char(gold + ord("A")))
        .when(F.col("item_id") % 5 == 1, gold.cast("string"))
        .when(F.col("item_id") % 5 == 2, F.lit("4"))
        .when(F.col("item_id") % 5 == 4, F.lower(F.char(gold + ord("A"))))
    )
    return joined.select(
        F.when(F.col("item_id") % 7 != 0, F.concat(F.lit("q"), F.col("item_id").cast("string"))).alias("id"),
        F.when(F.col("item_id") % 19 == 18, F.lit("  ")).otherwise(F.col("text")).alias("Question"),
        F.when(style == 0, F.to_json("opts")).when(style == 1, F.array_join("opts", " || ")).alias("options"),
        F.when(style == 2, F.array_join("opts", "; ")).alias("choices"),
        answer.alias("answer"),
        F.lit("benchmark").alias("file_stem"),
        F.col("item_id").alias("source_row"),
    )


MCQ_SQL = r"""
opt AS (
  SELECT b.item_id, p.place, trim(regexp_replace(o.text, '[^A-Za-z ]', '', 'g')) AS option
  FROM benchmark b CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS place) p
  JOIN benchmark o ON o.item_id = (b.item_id + (p.place + 1) % 4) % (SELECT count(*) FROM benchmark)
),
mcq AS (
  SELECT item_id, CASE WHEN item_id % 7 <> 0 THEN 'q' || item_id::VARCHAR ELSE 'benchmark-' || item_id::VARCHAR END AS qid,
    regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS question,
    CASE WHEN item_id % 5 IN (0, 1, 4) THEN item_id % 4 WHEN item_id % 5 = 2 THEN 3 END::INTEGER AS answer_index,
    (SELECT list(option ORDER BY place) FROM opt WHERE opt.item_id = benchmark.item_id) AS options
  FROM benchmark WHERE item_id % 19 <> 18
)"""
