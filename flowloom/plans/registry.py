"""Registration of queries beside their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function's name; ``sql`` is for DuckDB."""

        def add(function: Query) -> Query:
            self.queries[function.__name__.rstrip("_")] = function
            if sql is not None:
                self.sql[function.__name__.rstrip("_")] = sql
            return function

        return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
