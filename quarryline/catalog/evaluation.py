"""Benchmark, scoring and accuracy queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.catalog.tables import MCQ_SQL, mcq_rows, table
from quarryline.functions.text import tokens
from quarryline.operators import mcq, scoring
from quarryline.operators.lookup import lookup
from quarryline.session import new_folder, spread, stage
from quarryline.sources import benchmarks, sinks
from quarryline.sources.corpus import union_by_name
from quarryline.sources.json_lists import WRAPPERS

K = 3
SEEDS = [0, 1, 2]
LIMIT = 64
ALPHA = 0.1
OPTION_KEYS = ["qid", "option_idx"]


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcq.normalize_mcq(mcq_rows(spark, sf_dir))


def normalize_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select(
        "qid", "question", "answer_index", F.size("options").alias("n_options"), *[F.get("options", F.lit(i)).alias(f"option_{i}") for i in range(4)]
    )


ITEMS_PER_FILE = 64


def mcq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark in all forms a file may have: CSV, JSON lines, and JSON lists, bare or under one of two names."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"))
    path = new_folder(spark, "benchmark")
    items.write.csv(f"{path}/csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    items.write.json(f"{path}/jsonl")
    listed = items.groupBy(F.floor(F.col("id").cast("bigint") / ITEMS_PER_FILE).alias("file")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("id", "question"))), ",\n"), F.lit("]")).alias("list")
    )
    forms = {"list": F.col("list")}
    forms |= {name: F.concat(F.lit(f'{{"{name}": '), "list", F.lit("}")) for name in WRAPPERS}
    for name, text in forms.items():
        listed.select("file", text.alias("value")).write.partitionBy("file").text(f"{path}/{name}")
    formats = {"csv": "csv", "jsonl": "jsonl", **dict.fromkeys(forms, "json")}
    return union_by_name([
        benchmarks.mcq_scan(spark, f"{path}/{name}", fmt).select(F.lit(name).alias("format"), "id", "question") for name, fmt in formats.items()
    ])


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 4 == 0, "dev").otherwise("test").alias("split"),
        F.concat(F.lit("CDPK_"), "lang", F.lit("_"), F.when(F.col("doc_id") % 4 == 0, "dev").otherwise("test"), F.lit(".csv")).alias("file"),
        "doc_id",
        "text",
    )
    base = new_folder(spark, "categories")
    for split in ("dev", "test"):
        part = items.filter(F.col("split") == split).drop("split")
        part.write.partitionBy("file").csv(f"{base}/{split}", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    combined = [benchmarks.combine_category_files(spark, base, split, "file=CDPK_*_{split}.csv") for split in ("dev", "test")]
    return combined[0].unionByName(combined[1])


def combine_category_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir).select("split", "category_file", F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"))


def combine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.combine_report(_combined(spark, sf_dir))


def _targets_and_pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    examples = stage(_examples(spark, sf_dir), "examples")
    targets = mcq.example_index(examples, ["source_row"]).filter(F.col("answer_index").isNotNull())
    return stage(targets, "targets"), stage(mcq.fewshot_pool(examples, ["source_row"]), "pool")


def fewshot_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, pool = _targets_and_pool(spark, sf_dir)
    shots = mcq.fewshot_select(targets, pool, K, SEEDS)
    return lookup(shots, pool.select("pos", F.col("qid").alias("shot_qid")), ["pos"])


def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, pool = _targets_and_pool(spark, sf_dir)
    shots = mcq.fewshot_select(targets, pool, K, SEEDS)
    return mcq.build_prompts(targets, shots, pool, SEEDS).select("seed", "qid", "prompt")


def explode_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcq.explode_options(_examples(spark, sf_dir)).select("qid", "answer_index", "option_idx", "completion")


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an example of five options; the fifth never has tokens."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("qid"),
        F.when(F.col("doc_id") % 6 != 5, F.col("doc_id") % 4).alias("answer_index"),
        F.col("lang").alias("checkpoint"),
        (F.col("doc_id") % 30).alias("seed"),
        F.explode(F.sequence(F.lit(0), F.lit(4))).alias("option_idx"),
    )


def _token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents dealt to four options; a longer word is less likely."""
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = texts.select(F.col("doc_id").alias("qid"), F.posexplode_outer(tokens(F.col("text"))).alias("i", "w"))
    return words.filter(F.col("w").isNotNull()).select("qid", (F.col("i") % 4).alias("option_idx"), (-0.25 - F.length("w")).cast("double").alias("logprob"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.option_scores(_token_logprobs(spark, sf_dir), _options(spark, sf_dir).select(*OPTION_KEYS), OPTION_KEYS)


def option_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select(*OPTION_KEYS, F.round("score", 6).alias("score"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scores(spark, sf_dir).join(_options(spark, sf_dir), OPTION_KEYS)
    return scoring.predict_option(scored, ["qid", "checkpoint", "seed"])


def predict_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("qid", "pred_index", "pred_letter", "gold_index", "gold_letter", "correct")


def mcq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.mcq_accuracy(_predictions(spark, sf_dir), ["checkpoint", "seed"])


def repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.repeat_summary(mcq_accuracy(spark, sf_dir))


def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = _predictions(spark, sf_dir)
    path = new_folder(spark, "results")
    scored = predictions.filter(F.col("gold_index").isNotNull()).drop("scores")
    sinks.write_results(scoring.mcq_accuracy(predictions, ["checkpoint", "seed"]), scored, path)
    rows = spark.read.schema("result struct<qid bigint, correct boolean, pred_letter string>, checkpoint string, seed bigint").json(f"{path}/rows")
    runs = spark.read.csv(f"{path}/runs", header=True, schema="checkpoint string, seed bigint, total_scored bigint, total_skipped bigint, correct bigint, accuracy double")
    counted = rows.groupBy("checkpoint", "seed").agg(
        F.count("*").alias("examples"), F.count(F.when(F.col("result.correct"), 1)).alias("correct_rows")
    )
    return runs.join(counted, ["checkpoint", "seed"], "left").na.fill(0, ["examples", "correct_rows"])


def _checkpoint(step: Column) -> Column:
    return F.concat("source", F.when(step == 0, "").when(step == 1, ":last").when(step == 2, " :Latest ").otherwise(F.concat(F.lit(":"), (step * 500).cast("string"))))


def pending_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 6).alias("step")).distinct()
    existing = names.filter(F.col("step") > 2).select(
        F.concat("source", F.lit(":"), (F.col("step") * 500).cast("string")).alias("label"),
        F.explode(F.sequence(F.lit(5).cast("bigint"), F.lit(12).cast("bigint"))).alias("seed"),
    )
    return scoring.pending_evals(names.select(_checkpoint(F.col("step")).alias("checkpoint")), 0, 9, existing)


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    models = documents.select(F.col("source").alias("name"), F.concat(F.lit("hub/"), "source").alias("model")).distinct()
    extra = documents.select(F.col("lang").alias("name"), F.concat(F.lit("local/"), "lang").alias("model")).distinct()
    graded = documents.join(table(spark, sf_dir, "labels"), "doc_id").filter("lang <> 'de'")
    named = graded.select(F.col("source").alias("name"), "quality").unionByName(graded.select(F.col("lang").alias("name"), "quality"))
    results = named.groupBy("name").agg(
        F.count("*").alias("total_scored"), F.sum("quality").alias("correct"), F.lit(0).cast("bigint").alias("total_skipped"),
        F.avg("quality").alias("accuracy"), F.lit(None).cast("string").alias("error"),
    )
    failures = documents.filter("lang = 'de'").select(
        F.col("lang").alias("name"), F.lit(None).cast("bigint").alias("total_scored"), F.lit(None).cast("bigint").alias("correct"),
        F.lit(None).cast("bigint").alias("total_skipped"), F.lit(None).cast("double").alias("accuracy"), F.lit("error: out of memory").alias("error"),
    ).distinct()
    return scoring.model_comparison(models, extra, results.unionByName(failures))


def context_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompt and completion: the completion is every word after the first 40 + doc_id % 50."""
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = texts.select("doc_id", tokens(F.col("text")).alias("w"))
    head = (40 + F.col("doc_id") % 50).cast("int")
    split = words.select(
        "doc_id",
        F.slice("w", F.lit(1), head).alias("prompt_tokens"),
        F.slice("w", head + 1, F.greatest(F.size("w"), F.lit(1))).alias("completion_tokens"),
    )
    cut = scoring.context_truncate(split, LIMIT)
    return cut.select(
        "doc_id", F.array_join("prompt_tokens", " ").alias("prompt"), F.array_join("completion_tokens", " ").alias("completion"), "scored_tokens"
    )


def ngram_option_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = _examples(spark, sf_dir).withColumn("prompt", mcq.question_block(answered=False))
    options = stage(mcq.explode_options(examples).select(*OPTION_KEYS, "prompt", "completion"), "options")
    scores = scoring.ngram_option_scores(spread(table(spark, sf_dir, "documents").select("text")), options, OPTION_KEYS, ALPHA)
    return scores.select(*OPTION_KEYS, F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_mcq, mcq_scan, combine_category_files, combine_report, fewshot_select, build_prompts, explode_options, option_scores,
        predict_option, mcq_accuracy, repeat_summary, write_results, pending_evals, model_comparison, context_truncate,
        ngram_option_scores,
    )
}

_HASH = "('0x' || substr(md5((seed + target_index)::VARCHAR || ':{i}'), 1, 13))::BIGINT"
_SHOTS = MCQ_SQL + f""",
pool AS (SELECT *, row_number() OVER (ORDER BY qid) - 1 AS pos FROM mcq WHERE answer_index IS NOT NULL),
targets AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS target_index FROM mcq),
seeded AS (
  SELECT s.seed, t.target_index, t.qid, p.pos AS start, (SELECT count(*) FROM pool) - 1 AS free
  FROM targets t JOIN pool p USING (qid), (SELECT unnest([0, 1, 2])::BIGINT AS seed) s WHERE t.answer_index IS NOT NULL),
d0 AS (SELECT *, {_HASH.format(i=0)} % (free - 2) AS p0 FROM seeded),
d1 AS (SELECT *, {_HASH.format(i=1)} % (free - 1) AS t1 FROM d0),
d1b AS (SELECT *, CASE WHEN t1 = p0 THEN free - 2 ELSE t1 END AS p1 FROM d1),
d2 AS (SELECT *, {_HASH.format(i=2)} % free AS t2 FROM d1b),
d2b AS (SELECT *, CASE WHEN t2 = p0 OR t2 = p1 THEN free - 1 ELSE t2 END AS p2 FROM d2),
picks AS (SELECT *, unnest([0, 1, 2]) AS slot, unnest([p0, p1, p2]) AS pick FROM d2b),
shots AS (SELECT seed, target_index, qid, slot, CASE WHEN pick < start THEN pick ELSE pick + 1 END AS pos FROM picks)"""

_BLOCK = """'Question: ' || question || E'\\nOptions:\\nA. ' || options[1] || E'\\nB. ' || options[2] || E'\\nC. ' || options[3] || E'\\nD. ' || options[4] || E'\\nAnswer:'"""

_SCORES = r"""
words AS (SELECT doc_id AS qid, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents),
dealt AS (SELECT qid, (i % 4)::INTEGER AS option_idx, (-0.25 - length(w[i + 1]))::DOUBLE AS logprob FROM (SELECT *, unnest(range(len(w))) AS i FROM words)),
opts AS (
  SELECT doc_id AS qid, CASE WHEN doc_id % 6 <> 5 THEN doc_id % 4 END AS answer_index, lang AS checkpoint, doc_id % 30 AS seed, o.option_idx
  FROM documents, (SELECT unnest([0, 1, 2, 3, 4])::INTEGER AS option_idx) o),
scores AS (
  SELECT o.*, coalesce(m.score, '-Infinity'::DOUBLE) AS score FROM opts o
  LEFT JOIN (SELECT qid, option_idx, avg(logprob) AS score FROM dealt GROUP BY ALL) m USING (qid, option_idx)),
preds AS (
  SELECT qid, checkpoint, seed, answer_index AS gold_index, option_idx AS pred_index FROM scores
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, option_idx) = 1),
acc AS (
  SELECT checkpoint, seed, count(gold_index) AS total_scored, count(*) - count(gold_index) AS total_skipped,
    count(*) FILTER (pred_index = gold_index) AS correct,
    CASE WHEN count(gold_index) > 0 THEN count(*) FILTER (pred_index = gold_index) / count(gold_index)::DOUBLE ELSE 0 END AS accuracy
  FROM preds GROUP BY checkpoint, seed)"""

ORACLE = {
    "normalize_mcq": f"""
      WITH {MCQ_SQL} SELECT qid, question, answer_index, len(options)::INTEGER AS n_options,
        options[1] AS option_0, options[2] AS option_1, options[3] AS option_2, options[4] AS option_3 FROM mcq""",
    "mcq_scan": "SELECT f.format, item_id::VARCHAR AS id, text AS question FROM benchmark, (SELECT unnest(['csv', 'jsonl', 'list', 'examples', 'data']) AS format) f",
    "combine_category_files": """
      SELECT CASE WHEN doc_id % 4 = 0 THEN 'dev' ELSE 'test' END AS split,
        'CDPK_' || lang || '_' || CASE WHEN doc_id % 4 = 0 THEN 'dev' ELSE 'test' END || '.csv' AS category_file, doc_id, md5(text) AS text_md5 FROM documents""",
    "combine_report": """
      SELECT CASE WHEN doc_id % 4 = 0 THEN 'dev' ELSE 'test' END AS split, count(DISTINCT lang) AS files, count(*) AS rows FROM documents GROUP BY 1""",
    "fewshot_select": f"""
      WITH {_SHOTS} SELECT s.seed, s.target_index, s.qid, s.slot, s.pos, p.qid AS shot_qid FROM shots s JOIN pool p USING (pos)""",
    "build_prompts": f"""
      WITH {_SHOTS}, blocks AS (SELECT pos, {_BLOCK} || ' ' || options[answer_index + 1] || E'\\n\\n' AS block FROM pool),
      context AS (SELECT seed, target_index, string_agg(block, '' ORDER BY slot) AS context FROM shots JOIN blocks USING (pos) GROUP BY ALL)
      SELECT seed, qid, E'You are taking a pedagogy multiple-choice exam.\\nRead each question and options, then continue by writing the best answer text.\\n\\n'
        || context || {_BLOCK} || E'\\n\\n' AS prompt
      FROM targets JOIN context USING (target_index)""",
    "explode_options": f"""
      WITH {MCQ_SQL} SELECT qid, answer_index, i::INTEGER AS option_idx, ' ' || options[i + 1] AS completion
      FROM (SELECT *, unnest(range(len(options))) AS i FROM mcq)""",
    "option_scores": f"WITH {_SCORES} SELECT qid, option_idx, round(score, 6) AS score FROM scores",
    "predict_option": f"""
      WITH {_SCORES} SELECT qid, pred_index, chr(65 + pred_index) AS pred_letter, gold_index, chr(65 + gold_index::INTEGER) AS gold_letter,
        pred_index = gold_index AS correct FROM preds""",
    "mcq_accuracy": f"WITH {_SCORES} SELECT * FROM acc",
    "repeat_summary": f"""
      WITH {_SCORES} SELECT checkpoint, count(*) AS runs, round(avg(accuracy), 6) AS mean_accuracy,
        round(coalesce(stddev_samp(accuracy), 0), 6) AS std_accuracy,
        round(1.96::DOUBLE * coalesce(stddev_samp(accuracy), 0) / sqrt(count(*)), 6) AS ci95_half_width,
        round(min(accuracy), 6) AS min_accuracy, round(max(accuracy), 6) AS max_accuracy FROM acc GROUP BY checkpoint""",
    "write_results": f"WITH {_SCORES} SELECT *, total_scored AS examples, correct AS correct_rows FROM acc",
    "pending_evals": """
      WITH names AS (SELECT DISTINCT source AS tag, doc_id % 6 AS s FROM documents),
      grid AS (SELECT tag, CASE WHEN s > 2 THEN s * 500 END AS step, n.seed FROM names, (SELECT unnest(range(10)) AS seed) n)
      SELECT tag, step, tag || ':' || coalesce(step::VARCHAR, 'last') AS label, seed FROM grid WHERE step IS NULL OR seed NOT BETWEEN 5 AND 12""",
    "model_comparison": """
      WITH graded AS (SELECT d.source, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE lang <> 'de'),
      named AS (SELECT source AS name, quality FROM graded UNION ALL SELECT lang, quality FROM graded),
      res AS (SELECT name, count(*) AS total_scored, sum(quality)::BIGINT AS correct, avg(quality) AS accuracy FROM named GROUP BY name),
      models AS (SELECT DISTINCT source AS name, 'hub/' || source AS model FROM documents UNION ALL SELECT DISTINCT lang, 'local/' || lang FROM documents)
      SELECT name, model, round(accuracy, 6) AS accuracy, correct, total_scored, CASE WHEN accuracy IS NOT NULL THEN 0::BIGINT END AS total_skipped,
        CASE WHEN accuracy IS NOT NULL THEN 'ok' WHEN name = 'de' THEN 'error: out of memory' ELSE 'error: no result' END AS status
      FROM models LEFT JOIN res USING (name)""",
    "context_truncate": rf"""
      WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w, 40 + doc_id % 50 AS h FROM documents),
      cut AS (SELECT doc_id, w[1:h] AS p, w[h + 1:] AS c FROM words),
      kept AS (
        SELECT doc_id, c, p, CASE WHEN len(p) + len(c) <= {LIMIT} THEN len(p) ELSE greatest({LIMIT} - len(c), 0) END AS np,
          CASE WHEN len(p) + len(c) > {LIMIT} THEN least(len(c), {LIMIT}) ELSE len(c) END AS nc FROM cut)
      SELECT doc_id, array_to_string(p[len(p) - np + 1:], ' ') AS prompt, array_to_string(c[len(c) - nc + 1:], ' ') AS completion,
        (nc - CASE WHEN np = 0 AND nc > 0 THEN 1 ELSE 0 END)::INTEGER AS scored_tokens FROM kept""",
    "ngram_option_scores": rf"""
      WITH {MCQ_SQL}, docs AS (SELECT regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents),
      bi AS (SELECT w[i] AS prev, w[i + 1] AS tok FROM (SELECT w, unnest(range(1, len(w))) AS i FROM docs)),
      pairs AS (SELECT prev, tok, count(*) AS c FROM bi GROUP BY ALL), hist AS (SELECT prev, count(*) AS h FROM bi GROUP BY prev),
      vocab AS (SELECT count(DISTINCT t) AS v FROM (SELECT unnest(w) AS t FROM docs)),
      comp AS (SELECT qid, i::INTEGER AS option_idx, list_concat(['Answer:'], regexp_extract_all(options[i + 1], '[^ \t\n\r\f]+')) AS w FROM (SELECT *, unnest(range(len(options))) AS i FROM mcq)),
      toks AS (SELECT qid, option_idx, w[i] AS prev, w[i + 1] AS tok FROM (SELECT *, unnest(range(1, len(w))) AS i FROM comp))
      SELECT qid, option_idx, round(avg(ln((coalesce(c, 0) + {ALPHA}::DOUBLE) / (coalesce(h, 0) + {ALPHA}::DOUBLE * v))), 6) AS score
      FROM toks LEFT JOIN pairs USING (prev, tok) LEFT JOIN hist USING (prev), vocab GROUP BY qid, option_idx""",
}
