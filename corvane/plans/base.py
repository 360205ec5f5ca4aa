"""The catalogue of named queries, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as X


@dataclass(frozen=True)
class Query:
    build: Callable[[X.Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def add(name: str, build: Callable[[X.Tables], DataFrame], sql: str | None = None) -> None:
    CATALOG[name] = Query(build, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=q: q.build(X.Tables(spark, sf_dir))) for name, q in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in CATALOG.items() if q.sql}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query by its name."""
    return queries()[name](spark, sf_dir)
