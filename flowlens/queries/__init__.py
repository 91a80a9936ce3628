"""Registered queries over the given tables."""

from __future__ import annotations

from . import aggregates, cleaning, samples, scores, storage  # noqa: F401
from .registry import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
