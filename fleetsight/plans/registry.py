"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fleetsight.plans.fixture_sql import with_tables
from fleetsight.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _shipped(fn):
    """The query with the package sent to the workers first."""
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)
    return run


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name the derived tables of ``fixture_sql``."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = _shipped(fn)
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn
    return add
