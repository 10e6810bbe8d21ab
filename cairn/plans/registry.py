"""The registered queries of the families and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import Graph, with_views

_ALL: dict[str, tuple[Callable[[Graph], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    def keep(f: Callable[[Graph], DataFrame]):
        _ALL[name] = f, sql
        return f
    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda f: lambda spark, sf_dir: f(Graph(spark, sf_dir)))(f) for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _ALL.items() if sql}
