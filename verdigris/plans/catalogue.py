"""The engine's registered queries: name -> (callable(spark, sf_dir), DuckDB SQL or None), by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]
CATALOGUE: dict[str, Entry] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query with its SQL."""

    def register(f):
        CATALOGUE[name or f.__name__] = (f, sql)
        return f

    return register


def load() -> dict[str, Entry]:
    from verdigris.plans import grids, metrics, pairs, quality, reports, texts  # noqa: F401  they register themselves

    return CATALOGUE
