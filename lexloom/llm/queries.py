"""Registry of the subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import queries_corpus, queries_duplicates, queries_moderation, queries_nearest, queries_personal, queries_splitting, queries_variants

_MODULES = [queries_personal, queries_nearest, queries_variants, queries_splitting, queries_duplicates, queries_corpus, queries_moderation]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
