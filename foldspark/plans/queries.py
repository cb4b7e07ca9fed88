"""Registered queries of the library's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldspark.plans.adapters import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, extra: dict[str, str] | None = None, name: str | None = None):
    """Registers a function of ``Tables``; ``sql`` is completed with the adapters' CTEs."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[key] = with_ctes(sql, extra)
        return f

    return register


from foldspark.plans import q_evaluate, q_hits, q_metrics, q_ontology, q_sources, q_structure  # noqa: E402, F401
