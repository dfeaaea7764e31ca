"""Query registry: name -> (callable, comparison SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.catalog.derive_sql import PREFIX
from feedloom.session import configure


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
_MODULES = (
    "functions", "library", "intake", "maintenance", "ingest", "directory", "pages", "assets",
    "streams",
)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the derived tables as ``t_*``."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        REGISTRY[name] = Query(run, PREFIX + sql if sql else None)
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"feedloom.catalog.{module}")
    return REGISTRY


def ts(col: str | Column, name: str | None = None) -> Column:
    """Timestamp as text, so that both engines print the same value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or col)


def big(col: str | Column, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint").alias(name or col)
