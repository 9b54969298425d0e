"""Names, Spark functions and reference SQL of all registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name; `sql` gives the same rows in ANSI SQL."""
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, directory: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, directory)
        if function.__name__ in QUERIES:
            raise ValueError(f"Query {function.__name__} exists already")
        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return run
    return register
