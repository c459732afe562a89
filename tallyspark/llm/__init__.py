"""Operators of a training-data pipeline (toxicity, near-duplicates, packing, ...).

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
