"""Name -> query and name -> oracle SQL of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import fixtures, star, stored, texts

_ENTRIES = [*star.ENTRIES, *texts.ENTRIES, *fixtures.ENTRIES, *stored.ENTRIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query, _ in _ENTRIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _ENTRIES if sql is not None}
