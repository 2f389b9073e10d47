"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, deal_finer
from ..sources.model import Model


class Catalog:
    """Collects ``name -> (Model -> DataFrame)`` and the matching SQL."""

    def __init__(self) -> None:
        self.builders: dict[str, Callable[[Model], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Model], DataFrame], sql: str | None = None) -> None:
        if name in self.builders:
            raise ValueError(f"query {name!r} registered twice")
        self.builders[name] = build
        if sql is not None:
            self.sql[name] = sql


def _runner(build: Callable[[Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Model(deal_finer(configure(spark)), folder))


def load_catalog() -> Catalog:
    from importlib import import_module
    cat = Catalog()
    for part in ("data", "graphs", "scoring", "decisions", "search", "learning", "streams"):
        import_module(f"{__name__}.{part}").register(cat)
    return cat


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _runner(b) for n, b in load_catalog().builders.items()}


def all_sql() -> dict[str, str]:
    return dict(load_catalog().sql)
