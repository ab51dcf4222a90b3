"""Operators for preparing training data: quality, duplicates, secrets, tokens, packing.

Nothing outside this folder imports it, apart from ``corpus_pipeline.py`` and the
guarded registration in ``__spark_entry__.py``.
"""
