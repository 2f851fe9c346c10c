"""Corpus operators for training-data pipelines.

Nothing outside this package imports it.  Each operator module has a general
interface and a thin ``opN_*`` query in :mod:`flowspark.llm.queries`.
"""
