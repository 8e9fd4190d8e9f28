"""Operators of a training-data pipeline: deduplication, archives, extraction, quality, tokens, search and scans.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
