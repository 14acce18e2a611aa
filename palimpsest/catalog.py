"""Registry of the library's queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import context_queries, extended_queries, graph_queries, parse_queries, report_queries, retrieval_queries, scan_queries

_MODULES = (scan_queries, graph_queries, retrieval_queries, report_queries, parse_queries, context_queries, extended_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
