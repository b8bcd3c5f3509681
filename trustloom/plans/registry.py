"""Registry of named queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trustloom.plans.views import Tables
from trustloom.session import prepare

_MODULES = ("ingest", "quality", "joins", "aggregates", "windows", "text", "scalars", "features", "network",
            "learning", "streams")
_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin, if one exists."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"trustloom.plans.{module}")


def _runner(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(prepare(spark), sf_dir))

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _runner(fn) for name, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
