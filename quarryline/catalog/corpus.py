"""Corpus queries: scans, scores, order, shards and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.catalog.tables import (
    BLANKS_SQL,
    COPIES_SQL,
    KEYS,
    ORDER,
    SCORED_SQL,
    SHARDS_SQL,
    destination_copy,
    local_copy,
    score_keys,
    scored,
    shards,
    table,
    with_blanks,
)
from quarryline.operators import late, manifests, order, placement, quality, sampling
from quarryline.plans import curate
from quarryline.session import new_folder, stage
from quarryline.sources import corpus, files, listing, sinks

PERCENT = 16.5
BUDGET = 1_050_000
DOC_CAP = 1_000
MAX_CHARS = 500_000
FIRST_N = 250
ROWS_PER_SHARD = 70
LINE_ORDER = ["-score", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]


def scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.scan_corpus(spark, sf_dir, prefix="doc", num_files=1).select(
        "doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("chars")
    )


DOCS_PER_FILE = 250


def _document_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as a corpus of several files and folders, whose names follow the ids."""
    path = new_folder(spark, "corpus")
    rows = table(spark, sf_dir, "documents").withColumn("folder", F.format_string("%06d", F.floor(F.col("doc_id") / DOCS_PER_FILE)))
    rows.repartitionByRange("folder", "doc_id").sortWithinPartitions("folder", "doc_id").write.partitionBy("folder").parquet(path)
    return path


def scan_corpus_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole folder of files, and the files of one prefix up to the second name."""
    path = _document_files(spark, sf_dir)
    columns = ["doc_id", "lang", "source", "n_chars"]
    whole = corpus.scan_corpus(spark, path).select(F.lit("whole").alias("scan"), *columns)
    return whole.unionByName(corpus.scan_corpus(spark, path, prefix="folder=00000").select(F.lit("prefix").alias("scan"), *columns))


def multi_config_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places through all files of a config."""
    rows = corpus.multi_config_scan(spark, {"docs": _document_files(spark, sf_dir), "web": f"{sf_dir}/pages.parquet"}, {"docs": "text", "web": "html"})
    return rows.select("config", "source_row", F.md5("text").alias("text_md5"))


def union_by_name_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = corpus.union_by_name_scan(spark, [f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet"])
    return merged.select("doc_id", "lang", "source", "n_chars", "conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def drop_heavy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    joined = table(spark, sf_dir, "documents").join(embeddings, "doc_id", "left")
    return corpus.drop_heavy_columns(joined).withColumn("text", F.md5("text"))


def width_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths are measured where each table is read; only numbers are joined."""
    documents, embeddings = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    kept, dropped = documents.select("doc_id", corpus.row_width(documents).alias("kept")), embeddings.select("doc_id", corpus.row_width(embeddings.select("embedding")).alias("dropped"))
    return corpus.widths_saved(kept.join(dropped, "doc_id", "left"), "kept", "dropped")


def empty_file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.empty_file_audit(spark, sf_dir).select("name", "rows", "is_empty")


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def multi_config_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = {"docs": f"{sf_dir}/documents.parquet", "talks": f"{sf_dir}/conversations.parquet", "web": f"{sf_dir}/pages.parquet"}
    rows = corpus.multi_config_scan(spark, configs, {"docs": "text", "talks": "text", "web": "html"})
    return rows.select("config", "source_row", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("text_md5"))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes per prefix of a store of text objects, listed by executors."""
    path = new_folder(spark, "objects")
    objects = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 3).alias("part"), "text")
    objects.repartition("source", "part").write.partitionBy("source", "part").text(path)
    found = listing.list_files(spark, path, "*.txt").withColumn("prefix", F.regexp_extract("path", "/source=([^/]+)/", 1))
    return files.manifest_summary(found, ["prefix"])


def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "documents").select(F.col("source").alias("prefix"), F.col("n_chars").alias("length"))
    return files.manifest_summary(objects, ["prefix"])


def pointer_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("  path: doc_"), F.col("doc_id").cast("string"), F.lit(".txt \n")))
    pointers = documents.select(
        F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".dvc")).alias("file"),
        F.concat(F.lit("outs:\n- md5: "), F.md5("text"), F.lit("\n  size: 1\n"), F.coalesce(path, F.lit(""))).alias("value"),
    )
    digest = F.md5("text")
    store = documents.filter(F.col("doc_id") % 4 != 0).select(
        F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 30)).alias("object_key"),
        F.col("n_chars").alias("length"),
    )
    return files.pointer_manifest(pointers, store).select("file", "md5", "target", "object_key", "length", "status")


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "score")


def resolve_text_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = ("raw_text", "html", "text")
    found = [(name, quality.resolve_text_column(table(spark, sf_dir, name), candidates)) for name in ("documents", "pages", "conversations")]
    return spark.createDataFrame(found, "config string, text_column string")


def drop_blank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_blank_text(with_blanks(spark, sf_dir)).select("doc_id", "config", F.md5("text").alias("text_md5"))


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_profile(scored(spark, sf_dir), KEYS)


def score_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_profile(scored(spark, sf_dir))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under a score of few distinct values: hundreds of equal scores each."""
    lines = table(spark, sf_dir, "lineitem").withColumn("score", (F.col("l_discount") + F.col("l_tax")) / 2)
    return lines.select(*[c.lstrip("-") for c in LINE_ORDER])


def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.global_rank(scored_lines(spark, sf_dir), LINE_ORDER)


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return order.running_total(orders, ["-o_custkey", "o_orderkey"], "o_custkey")


def horizon_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_keys(spark, sf_dir)
    return order.budget_rows(rows, ORDER, "n_chars", BUDGET)


def tokenizer_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    lengths = stage(texts.select("doc_id", F.least(F.length("text"), F.lit(DOC_CAP)).cast("bigint").alias("chars")), "lengths")
    chosen = order.budget_rows(lengths, ["doc_id"], "chars", MAX_CHARS)
    cut = sampling.tokenizer_text(texts, doc_cap=DOC_CAP).drop("chars")
    return late.attach(chosen, cut, "doc_id").select("doc_id", "chars", F.md5("text").alias("text_md5"))


def sort_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sort_by(scored(spark, sf_dir), ORDER).select("doc_id", "score", "text")


def top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = score_keys(spark, sf_dir).select("doc_id", "score")
    cut = order.split(keys, ORDER)
    count = order.top_percent_count(cut.total_rows, PERCENT)
    chosen = order.top_rows(keys, ORDER, count, cut)
    return late.attach(chosen, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", rows=count).select("doc_id", "score", "text")


def top_percent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.top_percent(scored_lines(spark, sf_dir), LINE_ORDER, PERCENT)


def rank_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.rank_thresholds(score_keys(spark, sf_dir), ORDER, "score")


def rank_thresholds_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched thresholds, and whether the exact rank of each value lies within the stated error."""
    keys = score_keys(spark, sf_dir)
    found = order.rank_thresholds_sketched(keys, "score")
    marks = found.collect()  # three rows
    counts = [
        F.struct(
            F.lit(m["threshold"]).alias("threshold"),
            F.lit(m["rank"]).cast("bigint").alias("rank"),
            ((F.count(F.when(F.col("score") > m["value"], 1)) <= m["rank"] + m["error_rows"]) & (F.count(F.when(F.col("score") >= m["value"], 1)) >= m["rank"] - m["error_rows"])).alias("within"),
        )
        for m in marks
    ]
    return keys.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return order.top_rows(rows, ["source", "doc_id"], FIRST_N)


def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.shard_positions(scored(spark, sf_dir).select("doc_id", "score"), ORDER, ROWS_PER_SHARD)


def write_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "shards")
    keys = score_keys(spark, sf_dir).select("doc_id", "score")
    rows = late.attach(keys, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "score", "text")
    sinks.write_sharded(rows, path, ORDER, ROWS_PER_SHARD, rows_per_task=2 * ROWS_PER_SHARD, keys=keys)
    return sinks.read_shards(spark, path).select("shard", "shard_id", "row_in_shard", "doc_id", "score", F.md5("text").alias("text_md5"))


def curate_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents curated in two runs, of which the second finds half of the files done and merges the others."""
    path = new_folder(spark, "incremental")
    rows = scored(spark, sf_dir).select("doc_id", "text", *KEYS)
    for turn in (0, 1):
        half = rows.filter(F.floor(F.col("doc_id") / DOCS_PER_FILE) % 2 == turn).withColumn("folder", F.format_string("%06d", F.floor(F.col("doc_id") / DOCS_PER_FILE)))
        half.repartitionByRange("folder", "doc_id").sortWithinPartitions("folder", "doc_id").drop("doc_id").write.partitionBy("folder").mode("append").parquet(f"{path}/in")
        curate.curate(spark, f"{path}/in", f"{path}/out", KEYS, rows_per_shard=ROWS_PER_SHARD)
    return sinks.read_shards(spark, f"{path}/out").select("shard", "row_in_shard", F.md5("text").alias("text_md5"))


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = shards(spark, sf_dir)
    return manifests.pending_inputs(listing, local_copy(listing)).select("name", "docs", "length")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = shards(spark, sf_dir)
    status = F.when(F.col("length") % 10 == 0, "error").when(F.col("length") % 3 == 0, "skipped").otherwise("done")
    outcomes = local_copy(listing).select("name", status.alias("status"), F.col("length").alias("bytes"))
    return manifests.ingest_counts(listing, outcomes)


def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = shards(spark, sf_dir)
    return manifests.manifest_reconcile(listing, local_copy(listing), destination_copy(listing))


def transfer_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = shards(spark, sf_dir)
    return manifests.transfer_progress(listing, local_copy(listing), destination_copy(listing))


def stripe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.stripe_files(shards(spark, sf_dir), 6).select("name", "file_idx", "worker")


def worker_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.worker_load(placement.stripe_files(shards(spark, sf_dir), 6))


QUERIES = {
    f.__name__: f
    for f in (
        scan_corpus, scan_corpus_folder, multi_config_positions, union_by_name_scan, drop_heavy_columns, width_saved, empty_file_audit, multi_config_scan, file_manifest,
        manifest_summary, pointer_manifest, composite_score, resolve_text_column, drop_blank_text, quality_profile,
        score_profile, global_rank, running_total, horizon_prefix, tokenizer_sample, sort_by_quality, top_percent,
        top_percent_lines, rank_thresholds, rank_thresholds_sketched, first_n, shard_assignment, write_sharded, curate_incremental, incremental_ingest, ingest_counts,
        manifest_reconcile, transfer_progress, stripe_files, worker_load,
    )
}

_BEST = "ORDER BY score DESC, doc_id"
_LINES = """
lines AS (
  SELECT (l_discount + l_tax) / 2 AS score, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem
)"""
_LINE_BEST = "ORDER BY score DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate"

ORACLE = {
    "scan_corpus": "SELECT doc_id, lang, source, n_chars, length(text) AS chars FROM documents",
    "scan_corpus_folder": f"""
      SELECT 'whole' AS scan, doc_id, lang, source, n_chars FROM documents
      UNION ALL SELECT 'prefix', doc_id, lang, source, n_chars FROM documents WHERE doc_id // {DOCS_PER_FILE} < 10""",
    "multi_config_positions": """
      SELECT 'docs' AS config, row_number() OVER (ORDER BY doc_id) - 1 AS source_row, md5(text) AS text_md5 FROM documents
      UNION ALL SELECT 'web', row_number() OVER (ORDER BY page_id) - 1, md5(html) FROM pages""",
    "file_manifest": """
      SELECT source AS prefix, count(DISTINCT doc_id % 3) AS files, sum(strlen(text) + 1)::BIGINT AS bytes,
        round(sum(strlen(text) + 1)::BIGINT / 1073741824::DOUBLE, 6) AS gib FROM documents GROUP BY source""",
    "union_by_name_scan": """
      SELECT doc_id, lang, source, n_chars, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, NULL::VARCHAR AS role, md5(text) AS text_md5 FROM documents
      UNION ALL SELECT NULL, NULL, NULL, NULL, conv_id, turn, role, md5(text) FROM conversations""",
    "drop_heavy_columns": """
      SELECT d.doc_id, md5(d.text) AS text, d.lang, d.source, d.n_chars, e.label
      FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "width_saved": """
      WITH b AS (
        SELECT sum(16 + strlen(d.text) + strlen(d.lang) + strlen(d.source))::BIGINT AS kept_bytes, coalesce(sum(4 * len(e.embedding)), 0)::BIGINT AS dropped_bytes
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)
      SELECT *, round(100::DOUBLE * dropped_bytes / (kept_bytes + dropped_bytes), 6) AS dropped_percent FROM b""",
    "empty_file_audit": " UNION ALL ".join(
        f"SELECT '{name}.parquet' AS name, count(*) AS rows, count(*) = 0 AS is_empty FROM {name}" for name in _TABLES
    ),
    "multi_config_scan": """
      SELECT 'docs' AS config, row_number() OVER (ORDER BY doc_id) - 1 AS source_row, length(text) AS chars, md5(text) AS text_md5 FROM documents
      UNION ALL SELECT 'talks', row_number() OVER (ORDER BY conv_id, turn) - 1, length(text), md5(text) FROM conversations
      UNION ALL SELECT 'web', row_number() OVER (ORDER BY page_id) - 1, length(html), md5(html) FROM pages""",
    "manifest_summary": """
      SELECT source AS prefix, count(*) AS files, sum(n_chars)::BIGINT AS bytes, round(sum(n_chars)::BIGINT / 1073741824::DOUBLE, 6) AS gib
      FROM documents GROUP BY source""",
    "pointer_manifest": """
      WITH objects AS (SELECT md5(text) AS md5, max(n_chars) AS length FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1)
      SELECT 'p' || d.doc_id::VARCHAR || '.dvc' AS file, md5(d.text) AS md5, 'doc_' || d.doc_id::VARCHAR || '.txt' AS target,
        substr(md5(d.text), 1, 2) || '/' || substr(md5(d.text), 3) AS object_key, o.length,
        CASE WHEN o.length IS NULL THEN 'missing' ELSE 'present' END AS status
      FROM documents d LEFT JOIN objects o ON o.md5 = md5(d.text) WHERE d.doc_id % 9 <> 0""",
    "composite_score": f"WITH {SCORED_SQL} SELECT doc_id, score FROM scored",
    "resolve_text_column": """
      SELECT 'documents' AS config, CASE WHEN count(text) > 0 THEN 'text' END AS text_column FROM documents
      UNION ALL SELECT 'pages', CASE WHEN count(html) > 0 THEN 'html' END FROM pages
      UNION ALL SELECT 'conversations', CASE WHEN count(text) > 0 THEN 'text' END FROM conversations""",
    "drop_blank_text": f"WITH {BLANKS_SQL} SELECT doc_id, config, md5(text) AS text_md5 FROM src WHERE NOT blank",
    "quality_profile": f"WITH {SCORED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS key, min({k}) AS min, max({k}) AS max, round(avg({k}), 6) AS mean FROM scored" for k in KEYS
    ),
    "score_profile": f"WITH {SCORED_SQL} SELECT min(score) AS min, max(score) AS max, round(avg(score), 6) AS mean FROM scored",
    "global_rank": f"WITH {_LINES} SELECT *, row_number() OVER ({_LINE_BEST}) - 1 AS rank FROM lines",
    "running_total": """
      SELECT o_orderkey, o_custkey,
        coalesce(sum(o_custkey) OVER (ORDER BY o_custkey DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total_before
      FROM orders""",
    "horizon_prefix": f"""
      WITH {SCORED_SQL}
      SELECT doc_id, score, n_chars FROM (
        SELECT doc_id, score, n_chars, sum(n_chars) OVER ({_BEST} ROWS UNBOUNDED PRECEDING) - n_chars AS before FROM scored)
      WHERE before < {BUDGET}""",
    "tokenizer_sample": f"""
      SELECT doc_id, chars, md5(text) AS text_md5 FROM (
        SELECT doc_id, text, length(text) AS chars, sum(length(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - length(text) AS before
        FROM (SELECT doc_id, substr(text, 1, {DOC_CAP}) AS text FROM documents))
      WHERE before < {MAX_CHARS}""",
    "sort_by_quality": f"WITH {SCORED_SQL} SELECT doc_id, score, text FROM scored {_BEST}",
    "top_percent": f"""
      WITH {SCORED_SQL} SELECT doc_id, score, text FROM scored {_BEST}
      LIMIT (SELECT greatest(1, ceil(count(*) * ({PERCENT}::DOUBLE / 100::DOUBLE)))::BIGINT FROM scored)""",
    "top_percent_lines": f"""
      WITH {_LINES} SELECT * FROM lines {_LINE_BEST}
      LIMIT (SELECT greatest(1, ceil(count(*) * ({PERCENT}::DOUBLE / 100::DOUBLE)))::BIGINT FROM lines)""",
    "rank_thresholds": f"""
      WITH {SCORED_SQL}, ranked AS (SELECT score, row_number() OVER ({_BEST}) - 1 AS rank FROM scored),
      marks AS (
        SELECT unnest(['top_10_percent', 'top_25_percent', 'median']) AS threshold, unnest([count(*) // 10, count(*) // 4, count(*) // 2]) AS rank FROM scored)
      SELECT threshold, rank, score AS value FROM marks JOIN ranked USING (rank)""",
    "rank_thresholds_sketched": """
      SELECT unnest(['top_10_percent', 'top_25_percent', 'median']) AS threshold, unnest([count(*) // 10, count(*) // 4, count(*) // 2]) AS rank, true AS within FROM documents""",
    "first_n": f"SELECT source, doc_id, n_chars FROM documents ORDER BY source, doc_id LIMIT {FIRST_N}",
    "shard_assignment": f"""
      WITH {SCORED_SQL}, ranked AS (SELECT doc_id, score, row_number() OVER ({_BEST}) - 1 AS rank FROM scored)
      SELECT *, rank // {ROWS_PER_SHARD} AS shard_id, rank % {ROWS_PER_SHARD} AS row_in_shard FROM ranked""",
    "write_sharded": f"""
      WITH {SCORED_SQL}, ranked AS (SELECT doc_id, score, md5(text) AS text_md5, row_number() OVER ({_BEST}) - 1 AS rank FROM scored)
      SELECT 'shard_' || lpad((rank // {ROWS_PER_SHARD})::VARCHAR, 5, '0') AS shard, rank // {ROWS_PER_SHARD} AS shard_id,
        rank % {ROWS_PER_SHARD} AS row_in_shard, doc_id, score, text_md5 FROM ranked""",
    "curate_incremental": f"""
      WITH {SCORED_SQL}, ranked AS (SELECT md5(text) AS text_md5, row_number() OVER ({_BEST}) - 1 AS rank FROM scored)
      SELECT 'shard_' || lpad((rank // {ROWS_PER_SHARD})::VARCHAR, 5, '0') AS shard, rank % {ROWS_PER_SHARD} AS row_in_shard, text_md5 FROM ranked""",
    "incremental_ingest": f"WITH {COPIES_SQL} SELECT name, docs, length FROM shards WHERE name NOT IN (SELECT name FROM local_copy)",
    "ingest_counts": f"""
      WITH {COPIES_SQL}, outcomes AS (
        SELECT name, length AS bytes, CASE WHEN length % 10 = 0 THEN 'error' WHEN length % 3 = 0 THEN 'skipped' ELSE 'done' END AS status FROM local_copy)
      SELECT coalesce(status, 'pending') AS status, count(*) AS files, coalesce(sum(bytes), 0)::BIGINT AS bytes
      FROM shards LEFT JOIN outcomes USING (name) GROUP BY 1""",
    "manifest_reconcile": f"""
      WITH {COPIES_SQL}, names AS (SELECT name FROM shards UNION SELECT name FROM local_copy UNION SELECT name FROM destination),
      sizes AS (
        SELECT n.name, s.length AS source_length, l.length AS local_length, d.length AS dest_length FROM names n
        LEFT JOIN shards s ON s.name = n.name LEFT JOIN local_copy l ON l.name = n.name LEFT JOIN destination d ON d.name = n.name)
      SELECT *,
        CASE WHEN source_length IS NULL AND local_length IS NULL THEN 'absent' WHEN source_length IS NULL THEN 'extra'
          WHEN local_length IS NULL THEN 'missing' WHEN local_length <> source_length THEN 'partial' ELSE 'complete' END AS local_state,
        CASE WHEN source_length IS NULL AND dest_length IS NULL THEN 'absent' WHEN source_length IS NULL THEN 'extra'
          WHEN dest_length IS NULL THEN 'missing' WHEN dest_length <> source_length THEN 'partial' ELSE 'complete' END AS dest_state
      FROM sizes""",
    "transfer_progress": f"""
      WITH {COPIES_SQL}, places AS (
        SELECT 'source' AS place, count(*) AS files, coalesce(sum(length), 0)::BIGINT AS bytes FROM shards
        UNION ALL SELECT 'local', count(*), coalesce(sum(length), 0)::BIGINT FROM local_copy
        UNION ALL SELECT 'destination', count(*), coalesce(sum(length), 0)::BIGINT FROM destination)
      SELECT place, files, bytes, round(100::DOUBLE * files / (SELECT count(*) FROM shards), 6) AS files_percent,
        round(100::DOUBLE * bytes / (SELECT sum(length)::BIGINT FROM shards), 6) AS bytes_percent FROM places""",
    "stripe_files": f"WITH {SHARDS_SQL}, i AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS file_idx FROM shards) SELECT name, file_idx, file_idx % 6 AS worker FROM i",
    "worker_load": f"""
      WITH {SHARDS_SQL}, i AS (SELECT length, (row_number() OVER (ORDER BY name) - 1) % 6 AS worker FROM shards)
      SELECT worker, count(*) AS files, sum(length)::BIGINT AS bytes FROM i GROUP BY worker""",
}
