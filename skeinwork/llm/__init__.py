"""Operators for training-data pipelines, with their queries and SQL."""

from __future__ import annotations

import importlib

_QUERY_MODULES = ["clusters_queries", "similar_queries", "terms_queries", "text_queries"]


def query_modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in _QUERY_MODULES]
