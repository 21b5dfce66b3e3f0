"""Queries and their SQL twins. A query is a function of Views; its name begins with the id of the operator it shows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.views import Views, with_views

MODULES = ("analytics", "scans", "scalars", "documents", "retrieval", "gates", "mutations", "evaluation", "streams", "extensions")

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; without SQL it has no SQL form."""

    def add(f: Callable[[Views], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tessera.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for n, f in _QUERIES.items()}


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
