"""Query registry: each query with, where SQL can say it, the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.plans.inputs import TABLES, VIEWS, view_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``{name}`` in the SQL stands for a table or derived view."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            text = sql
            for view in VIEWS:
                text = text.replace("{" + view + "}", view_sql(view))
            for table in TABLES:
                text = text.replace("{" + table + "}", table)
            ORACLES[name] = text
        return build

    return register


def us(c: Column | str) -> Column:
    """Timestamp as microseconds, the same number in both engines."""
    return F.unix_micros(c)


def big(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


def joined(c: Column | str, separator: str = "|") -> Column:
    return F.array_join(c, separator)
