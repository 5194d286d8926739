"""Command line: ``python -m quarryline <job> ...`` or through ``spark-submit``."""

from __future__ import annotations

import argparse
import os

from quarryline.functions.text import blake2b_fraction, md5_fraction, tokens
from quarryline.operators import manifests, mcq, placement, quality, sampling, scoring
from quarryline.plans import curate, evaluate, track
from quarryline.session import build_session
from quarryline.sources import corpus, files, logs, sinks


HASHES = {"md5": md5_fraction, "blake2b": blake2b_fraction}


def _pair(text: str) -> tuple[str, str]:
    name, separator, value = text.partition("=")
    if not separator:
        raise argparse.ArgumentTypeError(f"expected name=value, got {text}")
    return name.strip(), value.strip()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarryline")
    top.add_argument("--master", default=os.environ.get("SPARK_MASTER"), help="left to the launcher by default")
    jobs = top.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("curate", help="sort a scored corpus into shards, or keep its best part")
    job.add_argument("source")
    job.add_argument("output")
    job.add_argument("--sort-keys", nargs="+", default=list(quality.SORT_KEYS))
    job.add_argument("--top-percent", type=float, default=100.0)
    job.add_argument("--rows-per-shard", type=int, default=sinks.ROWS_PER_SHARD)
    job.add_argument("--prefix", default="")
    job.add_argument("--num-files", type=int, default=-1)
    job.add_argument("--skip-sort", action="store_true", help="keep the input order and all columns but the heavy ones")
    job.add_argument("--report", action="store_true", help="also show the quality keys and the score")

    job = jobs.add_parser("sample", help="draw a seeded random subset into shards")
    job.add_argument("output")
    job.add_argument("--config", type=_pair, action="append", default=[], help="name=path, repeatable")
    job.add_argument("--dataset", help="a folder whose sub-folders are the configs, if none is named")
    job.add_argument("--hash", choices=sorted(HASHES), default="md5", help="blake2b gives subsets drawn with that hash elsewhere")
    job.add_argument("--ratio", type=float, default=sampling.DEFAULT_RATIO)
    job.add_argument("--seed", type=int, default=42)
    job.add_argument("--rows-per-shard", type=int, default=sinks.ROWS_PER_SHARD)
    job.add_argument("--text-column-candidates", nargs="+", default=list(quality.TEXT_CANDIDATES))

    job = jobs.add_parser("budget", help="tokens and training iterations of a folder of shards")
    job.add_argument("shards")
    job.add_argument("--token-col", default="token_count")
    job.add_argument("--total-batch-size", type=int, default=sampling.DEFAULT_BATCH)
    job.add_argument("--count-words", action="store_true", help="count the words of the text instead of a token column")

    job = jobs.add_parser("manifest", help="files, bytes and empty files below a folder")
    job.add_argument("path")

    job = jobs.add_parser("reconcile", help="compare the files of a source, a local and a destination folder")
    job.add_argument("source")
    job.add_argument("local")
    job.add_argument("destination")
    job.add_argument("--workers", type=int, default=6)

    job = jobs.add_parser("evaluate", help="few-shot evaluation with bigram models of corpora")
    job.add_argument("eval_file")
    job.add_argument("--dev-file")
    job.add_argument("--checkpoint", type=_pair, action="append", required=True, help="name=corpus path, repeatable")
    job.add_argument("--fewshot-k", type=int, default=3)
    job.add_argument("--max-examples", type=int)
    job.add_argument("--seed-start", type=int, default=0)
    job.add_argument("--seed-end", type=int, default=29, help="included")
    job.add_argument("--prompt-header", default=mcq.PROMPT_HEADER)
    job.add_argument("--overwrite", action="store_true", help="make runs again that the output holds")
    job.add_argument("--output")

    job = jobs.add_parser("compare", help="all models of a set on one benchmark; a model is the path of a corpus here")
    job.add_argument("eval_file")
    job.add_argument("--model-sets", help="JSON file of sets")
    job.add_argument("--model-set")
    job.add_argument("--extra-model", type=_pair, action="append", default=[], help="name=corpus path, repeatable")
    job.add_argument("--fewshot-k", type=int, default=3)
    job.add_argument("--seed", type=int, default=42)
    job.add_argument("--output")

    job = jobs.add_parser("track", help="milestones and best metrics of training runs")
    job.add_argument("path", help="folder of run folders")
    job.add_argument("specs", help="JSON file of run specs")
    job.add_argument("--url", default="")
    job.add_argument("--output")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(f"quarryline {args.job}", args.master)
    if args.job == "curate":
        print(curate.curate(spark, args.source, args.output, args.sort_keys, args.top_percent, args.rows_per_shard, args.prefix, args.num_files, args.skip_sort))
        if args.report:
            curate.quality_report(spark, args.source, args.sort_keys, args.prefix, args.num_files).show(truncate=False)
    elif args.job == "sample":
        configs = dict(args.config) or corpus.dataset_configs(spark, args.dataset)
        print(curate.random_subset(spark, configs, args.output, args.ratio, args.seed, args.rows_per_shard, args.text_column_candidates, HASHES[args.hash]))
    elif args.job == "budget":
        curate.subset_budget(spark, args.shards, args.token_col, args.total_batch_size, tokens if args.count_words else None).show(truncate=False)
    elif args.job == "manifest":
        files.manifest_summary(files.file_manifest(spark, args.path)).show(truncate=False)
        files.empty_file_audit(spark, args.path).filter("is_empty").show(truncate=False)
    elif args.job == "reconcile":
        listings = [files.file_manifest(spark, path, "*.parquet") for path in (args.source, args.local, args.destination)]
        manifests.transfer_progress(*listings).show()
        open_files = manifests.manifest_reconcile(*listings).filter("dest_state <> 'complete'")
        open_files.show(truncate=False)
        left = manifests.pending_inputs(listings[0], listings[2])
        placement.worker_load(placement.stripe_files(left, args.workers)).show()
    elif args.job == "evaluate":
        scorers = {name: evaluate.bigram_scorer(corpus.scan_corpus(spark, path).select("text")) for name, path in args.checkpoint}
        seeds = list(range(args.seed_start, args.seed_end + 1))
        found = evaluate.evaluate(spark, args.eval_file, scorers, seeds, args.dev_file, args.fewshot_k, args.max_examples, args.prompt_header, args.output, args.overwrite)
        found.summary.orderBy("checkpoint").show(truncate=False)
    elif args.job == "compare":
        extra = spark.createDataFrame(args.extra_model, "name string, model string")
        models = scoring.model_set(spark, args.model_sets, args.model_set) if args.model_sets else extra.limit(0)
        scorer = lambda path: evaluate.bigram_scorer(corpus.scan_corpus(spark, path).select("text"))
        evaluate.compare_models(spark, args.eval_file, models, scorer, extra, args.seed, args.output, fewshot_k=args.fewshot_k).show(truncate=False)
    elif args.job == "track":
        specs = spark.read.schema(logs.SPEC_SCHEMA).option("multiLine", True).json(args.specs)
        tables = track.track_runs(spark, args.path, specs, args.url, args.output)
        tables.registry.show(truncate=False)
        tables.best.join(tables.latest_step, "run").show(truncate=False)
        tables.milestones.orderBy("run", "step").show(50, truncate=False)


if __name__ == "__main__":
    main()
