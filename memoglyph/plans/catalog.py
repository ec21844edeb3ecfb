"""The registry of queries: a function of (spark, sf_dir) and the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memoglyph.views import RECORDS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, records: bool = False):
    """Registers a function under a name; with records, its SQL sees the records view."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {RECORDS_SQL}{sql}" if records else sql
        return f

    return put


def load() -> tuple[dict, dict]:
    from memoglyph.plans import graph_plans, lifecycle_plans, pack_plans, report_plans, search_plans, text_plans  # noqa: F401

    return QUERIES, ORACLE_SQL
