"""All registered queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import eval_queries, image_queries, search_queries, sync_queries, text_queries

_MODULES = (search_queries, sync_queries, text_queries, image_queries, eval_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
