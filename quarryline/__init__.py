"""Spark jobs that curate a text corpus, draw subsets, evaluate models and track training runs."""
