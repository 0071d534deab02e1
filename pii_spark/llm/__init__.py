"""Operators of a training-data pipeline: deduplication, language, tokens, packing, shards, images."""
