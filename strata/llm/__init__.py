"""Operators for large-scale training-data pipelines.

Each module is one operator with its own general interface; ``queries``
holds the registered driver queries and ``corpus_pipeline`` (repository
top) chains five of them. Nothing outside this package imports it.
"""
