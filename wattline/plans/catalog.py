"""Registry of runnable queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AREAS = ("cleaning", "features", "records", "reports", "anomaly", "forecast", "models", "trees", "recommend", "checks", "runs", "files")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional equivalent SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    import importlib

    for area in AREAS:
        importlib.import_module(f"wattline.plans.queries_{area}")
