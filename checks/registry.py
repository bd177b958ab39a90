"""Registered queries: one per operator, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.session import configure, materialize
from tallyhouse.sources import warehouse

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query, and the SQL that must give the same rows if there is one."""

    def add(query: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return query(configure(spark), folder.rstrip("/"))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def written_fact(spark: SparkSession, folder: str) -> DataFrame:
    """The fact as an analysis meets it: a written table, for queries that read it often."""
    return materialize(warehouse.retail_fact(spark, folder), "fact")


def written_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """The dirty table as an analysis meets it, which profiling and cleaning read several times."""
    return materialize(warehouse.retail_dirty(spark, folder), "dirty")
