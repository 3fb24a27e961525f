"""Named queries: a Spark job over one data folder and its checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paideon.session import tune
from paideon.sources.model_tables import ModelTables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[ModelTables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(ModelTables(tune(spark), folder))

    def oracle(self) -> str | None:
        return with_views(self.sql, "duckdb", CHECK_VIEWS) if self.sql else None


QUERIES: dict[str, Query] = {}
# Steps shared by several checking SQL texts.
CHECK_VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function of the model tables under `name`."""

    def register(build: Callable[[ModelTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register


def micros(column: str | Column) -> Column:
    """Timestamp as whole microseconds, the form both engines print alike."""
    value = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(value.cast("timestamp"))


def joined(array: str, field: str, sep: str = "|") -> Column:
    """One field of an array of structs as text."""
    return F.array_join(F.transform(array, lambda e: e[field].cast("string")), sep, "")
