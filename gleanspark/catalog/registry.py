"""Name → (Spark query, SQL statement)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanspark.catalog.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ["sources", "rows", "relational", "retrieval", "scoring", "quality"]


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame``; without ``sql`` only its rows are checked."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"gleanspark.catalog.{module}")
