"""A query is a name, a function (spark, folder) -> DataFrame and, where SQL can say it, an equivalent for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Registry:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            assert name not in self.queries, name
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Great-circle metres as SQL text."""
    return f"(2 * 6378137.0 * asin(least(1, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))"
