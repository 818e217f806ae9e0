"""Queries by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function as a named query."""

    def add(run: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"query {name} is already registered")
        CATALOG[name] = Query(run, sql)
        return run

    return add
