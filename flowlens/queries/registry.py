"""Registration of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..workspace import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_SHARED: dict[tuple, Any] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already there")
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def shared(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], Any]) -> Any:
    """Build a stored input or fitted model once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def is_shared(spark: SparkSession, sf_dir: str, what: str) -> bool:
    """Whether ``shared`` holds this already, so that others may read it."""
    return (spark.sparkContext.applicationId, sf_dir, what) in _SHARED
