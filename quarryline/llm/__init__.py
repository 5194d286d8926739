"""Operators of a training-data pipeline: counts, filters, duplicates, tokens, language models, shards."""
