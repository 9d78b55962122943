"""Registry of named queries: each is a Spark plan over the campus tables
derived from one directory of driver parquet files, plus (where SQL can
say it) the independent DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_views
from .sources.fixtures import Campus

_QUERIES: dict[str, Callable[[Campus], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Campus], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = with_views(sql)
        return fn
    return deco


def _load():
    # Importing the modules registers their queries.
    from . import catalog, catalog_changes  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Campus(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def campus_queries() -> dict[str, Callable]:
    """The registered plans as functions of a campus-like object (fixture
    adapter or stored tables)."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
