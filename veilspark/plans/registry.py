"""A small registry: a query's function and its SQL side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_package(spark)
                return f(spark, sf_dir)

            queries[f.__name__] = run
            if oracle is not None:
                sql[f.__name__] = oracle
            return f

        return add

    return queries, sql, query
