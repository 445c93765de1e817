"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import corpus_queries, language_queries, maintenance_queries, search_queries, surface_queries, symbol_queries

_MODULES = (search_queries, corpus_queries, symbol_queries, maintenance_queries, language_queries, surface_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
